"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.operators import chains, clean, harmonize, joins, stats
from tripmill.sources.tables import diaries, read

DAY = ("person", "day")
BACK = "signup"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIARY = """
t0 AS (SELECT user_id % 40 AS hh, user_id AS person, CAST(ts AS DATE) AS day, event_id,
    CAST(date_part('hour', ts) * 60 + date_part('minute', ts) AS BIGINT) AS start, event_type AS motive,
    CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS dest, user_id % 5 AS home, CAST(floor(value) AS BIGINT) AS minutes,
    1 + user_id % 7 AS weight, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS trip FROM events),
diary AS (SELECT *, coalesce(lag(dest) OVER (PARTITION BY person, day ORDER BY trip), home) AS origin FROM t0)
"""


def query(sql: str | None = None, diary: bool = False):
    """Register a function (spark, folder) -> DataFrame and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {DIARY} " if diary else "") + sql
        return f

    return add


def diary(spark: SparkSession, folder: str) -> DataFrame:
    return diaries(read(spark, folder, "events"))


def r(column, name: str):
    return F.round(column, 6).alias(name)


# -- chains -----------------------------------------------------------------------------


@query(
    """SELECT person, day, count(stay) AS stays, CAST(sum((stay = 0)::INT) AS BIGINT) AS zero_stays,
  CAST(coalesce(sum((stay < 0)::INT), 0) AS BIGINT) AS negative_stays, CAST(coalesce(sum((stay BETWEEN 1 AND 5)::INT), 0) AS BIGINT) AS short_stays,
  CAST(coalesce(sum(stay) FILTER (stay > 0), 0) AS BIGINT) AS stay_minutes, max(start + minutes) - min(start) AS day_length
FROM (SELECT *, lead(start) OVER (PARTITION BY person, day ORDER BY trip) - (start + minutes) AS stay FROM diary) GROUP BY person, day""".replace(
        "CAST(sum((stay = 0)::INT) AS BIGINT)", "CAST(coalesce(sum((stay = 0)::INT), 0) AS BIGINT)"
    ),
    diary=True,
)
def stay_screens(spark, folder):
    return chains.stay_screens(diary(spark, folder), DAY)


@query(
    """SELECT count(*) AS trips, CAST(sum((NOT first AND before IS DISTINCT FROM origin)::INT) AS BIGINT) AS zone_breaks,
  CAST(sum(coalesce(start < prev, false)::INT) AS BIGINT) AS disorder, CAST(sum(coalesce(start < prev_end, false)::INT) AS BIGINT) AS overlaps,
  CAST(sum(coalesce(start = prev, false)::INT) AS BIGINT) AS ties, CAST(sum((first AND origin <> home)::INT) AS BIGINT) AS first_away,
  CAST(sum((last AND dest <> home)::INT) AS BIGINT) AS last_away
FROM (SELECT *, lag(dest) OVER w AS before, lag(trip) OVER w IS NULL AS first, lead(trip) OVER w IS NULL AS last, lag(start) OVER w AS prev,
  lag(start + minutes) OVER w AS prev_end FROM diary WINDOW w AS (PARTITION BY person, day ORDER BY trip))""",
    diary=True,
)
def chain_report(spark, folder):
    return chains.chain_report(diary(spark, folder), DAY)


@query(
    """, s AS (SELECT *, CASE WHEN motive IS DISTINCT FROM 'signup' THEN false WHEN dest = home THEN true END AS sig,
  first(origin = home) OVER (PARTITION BY person, day ORDER BY trip) AS f FROM diary)
SELECT event_id, motive = 'signup' AND coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f) AS non_trip FROM s""",
    diary=True,
)
def at_home_walk(spark, folder):
    return chains.at_home_walk(diary(spark, folder), DAY, BACK).select("event_id", "non_trip")


@query(
    """, e AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN home ELSE origin END AS origin) FROM diary),
n AS (SELECT *, coalesce(lag(dest) OVER (PARTITION BY person, day ORDER BY trip), origin) AS fresh FROM e)
SELECT event_id, fresh AS origin, fresh IS DISTINCT FROM origin AS moved FROM n""",
    diary=True,
)
def continuous_origins(spark, folder):
    broken = diary(spark, folder).withColumn("origin", F.when(F.col("event_id") % 7 == 0, F.col("home")).otherwise(F.col("origin")))
    return chains.continuous_origins(broken, DAY).select("event_id", "origin", "moved")


@query(
    """, n AS (SELECT *, trip > 1 AND dest = home AND origin <> home AND motive <> 'signup' AS arrives FROM diary)
SELECT event_id, arrives, CASE WHEN arrives THEN 'signup' ELSE motive END AS motive FROM n""",
    diary=True,
)
def arrivals_home(spark, folder):
    return chains.arrivals_home(diary(spark, folder), DAY, BACK).select("event_id", "arrives", "motive")


@query(
    """, e AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE motive END AS motive, CASE WHEN event_id % 29 = 0 THEN NULL ELSE start END AS start) FROM diary),
p AS (SELECT *, coalesce(motive IS NULL AND dest = home AND origin <> home AND lead(motive) OVER w = 'signup' AND lead(start) OVER w IS NOT NULL
   AND lead(origin) OVER w = home AND lead(dest) OVER w = home, false) AS hit, lead(motive) OVER w AS m, lead(start) OVER w AS s FROM e
   WINDOW w AS (PARTITION BY person, day ORDER BY trip)),
q AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY person, day ORDER BY trip), false) AS gone FROM p)
SELECT event_id, CASE WHEN hit THEN m ELSE motive END AS motive, CASE WHEN hit THEN coalesce(start, s) ELSE start END AS start FROM q WHERE NOT gone""",
    diary=True,
)
def duplicate_returns(spark, folder):
    d = diary(spark, folder)
    d = d.withColumns({"motive": F.when(F.col("event_id") % 3 != 0, F.col("motive")), "start": F.when(F.col("event_id") % 29 != 0, F.col("start"))})
    return chains.duplicate_returns(d, DAY, BACK).select("event_id", "motive", "start")


#: Some evening starts are recorded as the small hours.
NIGHTS = """, e AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 AND start >= 1080 THEN start - 1080 ELSE start END AS start) FROM diary)"""


def wraps_sql(table: str) -> str:
    """CTEs that end in q: table plus wraps."""
    return f""", p AS (SELECT *, lag(start) OVER w AS prev, lag(motive) OVER w AS pm, coalesce(max((motive = 'purchase')::INT) OVER (PARTITION BY person, day ORDER BY trip ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later
  FROM {table} WINDOW w AS (PARTITION BY person, day ORDER BY trip)),
n AS (SELECT *, coalesce(((start <= 360 AND (prev >= 1080 OR (prev >= 720 AND motive = 'signup'))) OR (motive = 'signup' AND pm = 'purchase' AND prev >= 1080 AND start < 600)) AND later = 0, false) AS night FROM p),
k AS (SELECT *, start + 1440 * sum(night::INT) OVER (PARTITION BY person, day ORDER BY trip) AS clock FROM n),
q AS (SELECT *, night AND max(clock) OVER x - first(clock) OVER x < 1440 AS wraps FROM k
  WINDOW x AS (PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def slide_sql(table: str) -> str:
    """A recursive CTE walk over table (rn: place in the chain, wraps): start moved to the arrival."""
    test = "d.start < w.moved_end AND w.recorded_end - d.start <= w.reach AND NOT d.wraps"
    return f""", walk AS (
  SELECT person, day, trip, rn, start, start AS moved_start, start + minutes AS moved_end, start + minutes AS recorded_end, CASE WHEN motive = 'purchase' THEN 15 ELSE 60 END AS reach FROM {table} WHERE rn = 1
  UNION ALL
  SELECT d.person, d.day, d.trip, d.rn, d.start, CASE WHEN {test} THEN w.moved_end ELSE d.start END,
    CASE WHEN {test} THEN w.moved_end ELSE d.start END + d.minutes, d.start + d.minutes, CASE WHEN d.motive = 'purchase' THEN 15 ELSE 60 END
  FROM walk w JOIN {table} d ON d.person = w.person AND d.day = w.day AND d.rn = w.rn + 1)"""


def _nights(spark, folder):
    late = (F.col("event_id") % 5 == 0) & (F.col("start") >= 1080)
    return diary(spark, folder).withColumn("start", F.when(late, F.col("start") - 1080).otherwise(F.col("start")))


@query(
    NIGHTS + wraps_sql("e") + "SELECT event_id, wraps, CAST(sum(wraps::INT) OVER (PARTITION BY person, day ORDER BY trip) AS BIGINT) AS days FROM q",
    diary=True,
)
def day_wraps(spark, folder):
    return chains.day_wraps(_nights(spark, folder), DAY, ["purchase"], BACK, ["purchase"]).select("event_id", "wraps", "days")


@query()
def slide_to_arrival(spark, folder):
    d = chains.day_wraps(_nights(spark, folder), DAY, ["purchase"], BACK, ["purchase"])
    d = d.select("person", "day", "trip", "start", "minutes", "motive", "wraps")
    return chains.slide_to_arrival(d, DAY, ["purchase"]).select("person", "day", "trip", "start", "moved_start")


ORACLE_SQL["slide_to_arrival"] = (
    "WITH RECURSIVE " + DIARY + NIGHTS + wraps_sql("e") + ", g AS (SELECT *, trip AS rn FROM q)" + slide_sql("g")
    + "SELECT person, day, trip, start, moved_start FROM walk"
)


@query(
    """SELECT event_id, concat_ws(';', CASE WHEN start IS NULL THEN 'untimed' END, CASE WHEN start < prev THEN 'earlier' END, CASE WHEN start = prev THEN 'same_minute' END,
  CASE WHEN start < prev_end THEN 'overlap' END, CASE WHEN NOT first AND before IS DISTINCT FROM origin THEN 'discontinuous' END,
  CASE WHEN motive = 'signup' AND dest <> home THEN 'return_elsewhere' END, CASE WHEN first AND origin <> home THEN 'first_away' END,
  CASE WHEN last AND dest <> home THEN 'last_away' END) AS issues
FROM (SELECT *, lag(dest) OVER w AS before, lag(trip) OVER w IS NULL AS first, lead(trip) OVER w IS NULL AS last, lag(start) OVER w AS prev,
  lag(start + minutes) OVER w AS prev_end FROM diary WINDOW w AS (PARTITION BY person, day ORDER BY trip))""",
    diary=True,
)
def remaining_issues(spark, folder):
    return chains.remaining_issues(diary(spark, folder), DAY, BACK).select("event_id", "issues")


@query(
    """, p AS (SELECT *, CASE motive WHEN 'signup' THEN CASE WHEN dest = home THEN 'H' ELSE 'O' END WHEN 'purchase' THEN 'W' WHEN 'view' THEN 'S' ELSE 'O' END AS pur FROM diary),
q AS (SELECT *, row_number() OVER (PARTITION BY person, day, pur ORDER BY trip) AS nth, coalesce(lag(pur) OVER (PARTITION BY person, day ORDER BY trip), 'H') AS origin_purpose FROM p)
SELECT event_id, origin_purpose, CASE WHEN pur = 'W' AND nth > 1 THEN 'R' WHEN pur = 'S' AND nth > 1 THEN 'C' ELSE pur END AS purpose,
  CAST(start // 60 * 100 + start % 60 AS BIGINT) AS start_time FROM q""",
    diary=True,
)
def build_trips(spark, folder):
    d = chains.build_trips(diary(spark, folder), DAY, {"signup": "H", "purchase": "W", "view": "S"}, repeats={"W": "R", "S": "C"})
    return d.select("event_id", "origin_purpose", "purpose", "start_time")


# -- cleaning ---------------------------------------------------------------------------


def _slots(spark, folder):
    line = read(spark, folder, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.when(F.col(c) > lo, F.col(c)).alias(f"s{k}") for k, (c, lo) in enumerate((("l_quantity", 5), ("l_discount", 0.02), ("l_tax", 0.03)), 1)])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, leg, amount FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS leg, CASE WHEN l_quantity > 5 THEN l_quantity END AS amount FROM lineitem UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, CASE WHEN l_discount > 0.02 THEN l_discount END FROM lineitem UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3, CASE WHEN l_tax > 0.03 THEN l_tax END FROM lineitem) WHERE amount IS NOT NULL"""
)
def unpivot_legs(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return clean.unpivot_legs(_slots(spark, folder), keys, [{"amount": f"s{k}"} for k in (1, 2, 3)], "amount")


@query(
    """SELECT o_orderkey, CAST(coalesce(m, 0) AS BIGINT) AS trip_minutes FROM orders LEFT JOIN
  (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS m FROM lineitem WHERE l_linenumber <= 2 AND l_linestatus <> 'F' GROUP BY 1) ON o_orderkey = l_orderkey"""
)
def trip_minutes(spark, folder):
    legs = read(spark, folder, "lineitem").where("l_linenumber <= 2 AND l_linestatus <> 'F'")
    legs = legs.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("minutes"))
    return clean.trip_minutes(read(spark, folder, "orders").select("o_orderkey"), legs, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_orderpriority AS VARCHAR) IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def select_rows(spark, folder):
    kept = clean.select_rows(read(spark, folder, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_orderstatus": ["F"]})
    return kept.select("o_orderkey", "o_orderstatus")


@query(
    """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') AS area,
  lpad(CAST((c_custkey % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS at FROM customer"""
)
def area_key_time_text(spark, folder):
    c = read(spark, folder, "customer").withColumn("part", F.col("c_custkey") % 1000)
    return c.select("c_custkey", clean.area_key(["c_nationkey", "part"], [3, 4]).alias("area"), clean.time_text(F.col("c_custkey") % 1440).alias("at"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS dense_id FROM orders")
def dense_ids(spark, folder):
    return clean.dense_ids(read(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", F.col("dense_id").cast("long"))


@query(
    """WITH j AS (SELECT l_orderkey, o_orderpriority, o_custkey, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT count(DISTINCT o_orderpriority) <= 1 AS a, count(DISTINCT o_custkey) <= 1 AS b, count(DISTINCT l_linestatus) <= 1 AS c FROM j GROUP BY l_orderkey)
SELECT 'o_orderpriority' AS "column", bool_and(a) AS inherited FROM p UNION ALL SELECT 'o_custkey', bool_and(b) FROM p UNION ALL SELECT 'l_linestatus', bool_and(c) FROM p"""
)
def find_inherited_columns(spark, folder):
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    child = read(spark, folder, "lineitem").select("l_orderkey", "l_linestatus").join(orders, "l_orderkey")
    return clean.inherited_columns(child, "l_orderkey")


@query(
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 ELSE 1 END AS BIGINT) AS urgency,
  CAST((o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderstatus = 'O')::INT AS BIGINT) AS middling FROM orders"""
)
def spec_attributes(spark, folder):
    spec = {
        "urgency": {"column": "o_orderpriority", "values": {"1-URGENT": 5, "2-HIGH": 3}, "default": 1},
        "middling": {"column": "o_totalprice", "low": 1000, "high": 50000, "when": "o_orderstatus = 'O'"},
    }
    return clean.spec_attributes(read(spark, folder, "orders"), spec).select("o_orderkey", "urgency", "middling")


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 10 = 3 THEN s_nationkey + 100 END, s_nationkey) AS s_nationkey FROM supplier")
def patch_cells(spark, folder):
    s = read(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    fixes = s.where("s_suppkey % 10 = 3").select("s_suppkey", (F.col("s_nationkey") + 100).alias("value"))
    return clean.patch_cells(s, fixes, ["s_suppkey"], "s_nationkey")


@query(
    """SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR))), 1, 12) AS HUGEINT)) AS VARCHAR) AS digest FROM customer"""
)
def table_digest(spark, folder):
    return clean.table_digest(read(spark, folder, "customer").select("c_custkey", "c_nationkey"))


@query(
    """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 0.25 ELSE o_totalprice END AS o_totalprice, o_custkey FROM orders),
j AS (SELECT a.o_totalprice AS p, b.o_totalprice AS q FROM orders a JOIN b USING (o_orderkey))
SELECT 'o_totalprice' AS "column", CAST(sum((p <> q)::INT) AS BIGINT) AS rows_differing, round(max(abs(p - q)), 6) AS max_abs_diff, 'within' AS status FROM j
UNION ALL SELECT 'o_custkey', 0, 0.0, 'identical'"""
)
def compare_tables(spark, folder):
    a = read(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 0.25).otherwise(F.col("o_totalprice")))
    out = clean.compare_tables(a, b, ["o_orderkey"], ["o_totalprice", "o_custkey"], 0.5)
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 6)).withColumn("rows_differing", F.col("rows_differing").cast("long"))


@query(
    """SELECT event_id, CASE WHEN issues <> '' AND list_has_any(string_split(issues, ';'), ['return_elsewhere', 'overlap']) THEN true ELSE false END AS flagged FROM (
  SELECT event_id, concat_ws(';', CASE WHEN event_type = 'signup' THEN 'return_elsewhere' END, CASE WHEN value > 50 THEN 'overlap' END, CASE WHEN value < 5 THEN 'short' END) AS issues FROM events)"""
)
def drop_non_trips(spark, folder):
    e = read(spark, folder, "events").withColumn("f", F.array().cast("array<string>"))
    for test, code in ((F.col("event_type") == "signup", "return_elsewhere"), (F.col("value") > 50, "overlap"), (F.col("value") < 5, "short")):
        e = e.withColumn("f", clean.flag_add(F.col("f"), test, code))
    return e.select("event_id", clean.has_any(F.array_join("f", ";"), ["return_elsewhere", "overlap"]).alias("flagged"))


# -- harmonisation ----------------------------------------------------------------------


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'shop' ELSE 'other' END AS event_type FROM events")
def harmonize_map(spark, folder):
    e = read(spark, folder, "events").select("event_id", "event_type")
    return harmonize.harmonize_map(e, "event_type", {"click": "web", "view": "web", "purchase": "shop"}, ["error", "signup"], "other")


@query(
    """SELECT event_id, CASE WHEN k <> 7 THEN round(least(k / 2.0, 40.0), 6) END AS number, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS bin,
  CASE WHEN event_type = 'error' THEN 'bad' WHEN value > 30 THEN 'big' ELSE 'plain' END AS rule
FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"""
)
def number_bins_rules(spark, folder):
    e = read(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select(
        "event_id", F.round(harmonize.number_variable(["k"], 2, [7.0], 40), 6).alias("number"),
        harmonize.bins_variable(F.col("value"), [5, 20], ["low", "mid", "high"]).alias("bin"),
        harmonize.rules_variable([(F.col("value") > 30, "big"), (F.col("event_type") == "error", "bad")], "plain").alias("rule"),
    )


@query(
    """SELECT 'l_linestatus' AS feature, (SELECT count(*) FROM lineitem WHERE l_linestatus NOT IN (SELECT l_linestatus FROM lineitem WHERE l_orderkey < 3)) AS rows
UNION ALL SELECT 'l_returnflag', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN (SELECT l_returnflag FROM lineitem WHERE l_orderkey < 3))"""
)
def unsupported_level_counts(spark, folder):
    line = read(spark, folder, "lineitem")
    return harmonize.unsupported_levels(line, line.where("l_orderkey < 3"), ["l_linestatus", "l_returnflag"])


@query("SELECT event_id, round(value / (SELECT avg(value) FROM events), 6) AS value FROM events")
def normalize_weights(spark, folder):
    out = harmonize.normalize_weights(read(spark, folder, "events").select("event_id", "value"), "value")
    return out.withColumn("value", F.round("value", 6))


# -- joins ------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_from_parent(spark, folder):
    parent = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return joins.enrich_from_parent(read(spark, folder, "orders").select("o_orderkey", "o_custkey"), parent, ["o_custkey"]).select("o_orderkey", "c_nationkey")


@query(
    """SELECT hh, head, source FROM (SELECT hh, person AS head, CASE WHEN is_head THEN 'reported' ELSE 'oldest' END AS source,
  row_number() OVER (PARTITION BY hh ORDER BY is_head DESC, age DESC, person) AS n
  FROM (SELECT DISTINCT user_id % 40 AS hh, user_id AS person, user_id % 11 = 0 AS is_head, user_id * 7 % 90 AS age FROM events)) WHERE n = 1"""
)
def household_head(spark, folder):
    p = read(spark, folder, "events").select((F.col("user_id") % 40).alias("hh"), F.col("user_id").alias("person")).distinct()
    p = p.withColumn("is_head", F.col("person") % 11 == 0).withColumn("age", F.col("person") * 7 % 90)
    return joins.household_head(p, "hh", "person", "is_head", "age")


@query(
    """WITH p AS (SELECT user_id % 40 AS hh, user_id AS person, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a.hh, a.person, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS others_sum, max(b.n) AS others_max
FROM p a LEFT JOIN p b ON a.hh = b.hh AND a.person <> b.person GROUP BY a.hh, a.person"""
)
def other_members_aggregate(spark, folder):
    p = read(spark, folder, "events").groupBy((F.col("user_id") % 40).alias("hh"), F.col("user_id").alias("person")).agg(F.count("*").alias("n"))
    return joins.other_members(p, "hh", "n").select("hh", "person", "others_sum", "others_max")


@query("SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def orphans(spark, folder):
    parent = read(spark, folder, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.orphans(read(spark, folder, "orders"), parent, ["o_custkey"])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'removed' WHEN c_custkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM customer
WHERE (c_custkey % 5 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) OR (c_custkey % 11 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0)"""
)
def key_changes(spark, folder):
    c = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    after = c.where("c_custkey % 5 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 11 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return joins.key_changes(c.where("c_custkey % 7 <> 0"), after, "c_custkey", ["c_nationkey"])


@query(
    """, c AS (SELECT day, hh, person, list(motive ORDER BY trip) AS sig, list(start ORDER BY trip) AS s FROM diary GROUP BY day, hh, person HAVING count(*) >= 2)
SELECT * FROM (SELECT a.day, a.person AS person_a, b.person AS person_b, list_max(list_transform(list_zip(a.s, b.s), lambda x: abs(x[1] - x[2]))) AS max_offset
FROM c a JOIN c b ON a.day = b.day AND a.sig = b.sig AND a.hh < b.hh) WHERE max_offset <= 240""",
    diary=True,
)
def repeated_diary_pairs(spark, folder):
    return joins.repeated_diary_pairs(diary(spark, folder), ["day"], "hh", "person", "trip", "start", ["motive"], 240)


@query(
    """WITH own AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
par AS (SELECT c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT c_custkey, round(coalesce(own.v, CASE WHEN c_custkey % 2 = 0 THEN par.v END), 4) AS v FROM customer LEFT JOIN own ON c_custkey = o_custkey LEFT JOIN par USING (c_nationkey)"""
)
def fallback_join(spark, folder):
    c = read(spark, folder, "customer")
    own = read(spark, folder, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("v"))
    par = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    out = joins.fallback_join(c.select("c_custkey", "c_nationkey"), own, "c_custkey", par, "c_nationkey", "v", "c_custkey % 2 = 0")
    return out.select("c_custkey", F.round("v", 4).alias("v"))


# -- statistics -------------------------------------------------------------------------


@query("SELECT motive AS value, CAST(sum(weight) AS BIGINT) AS weight, round(sum(weight) / (SELECT sum(weight) FROM diary), 6) AS share FROM diary GROUP BY motive", diary=True)
def weighted_distribution(spark, folder):
    out = stats.weighted_distribution(diary(spark, folder), "motive", "weight")
    return out.withColumn("share", F.round("share", 6))


@query(
    """WITH p AS (SELECT l_quantity, l_discount AS a, 1 - l_discount AS b FROM lineitem)
SELECT 'a' AS class, round(sum(l_quantity * a), 3) AS weight, round(sum(l_quantity * a) / sum(l_quantity * a + l_quantity * b), 6) AS share FROM p
UNION ALL SELECT 'b', round(sum(l_quantity * b), 3), round(sum(l_quantity * b) / sum(l_quantity * a + l_quantity * b), 6) FROM p"""
)
def probabilistic_distribution(spark, folder):
    p = read(spark, folder, "lineitem").select(F.col("l_quantity").cast("double").alias("w"), F.col("l_discount").cast("double").alias("a")).withColumn("b", 1 - F.col("a"))
    out = stats.probabilistic_distribution(p, ["a", "b"], "w")
    return out.select("class", F.round("weight", 3).alias("weight"), F.round("share", 6).alias("share"))


@query("SELECT person, motive AS mode, n FROM (SELECT person, motive, count(*) AS n, row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, motive) AS k FROM diary GROUP BY 1, 2) WHERE k = 1", diary=True)
def modal_value_per_key(spark, folder):
    return stats.modal_value_per_key(diary(spark, folder), ["person"], "motive")


@query("SELECT person, day, arg_min(dest, trip) AS first_dest FROM diary WHERE motive IN ('purchase', 'view') GROUP BY 1, 2", diary=True)
def first_destination(spark, folder):
    return stats.first_destination(diary(spark, folder), DAY, "trip", "dest", "motive", ["purchase", "view"])


@query("SELECT c_nationkey, round(sum(a) / nullif(greatest(sum(b), 0), 0), 6) AS ratio FROM (SELECT c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS a, c_nationkey + 1 AS b FROM customer) WHERE a IS NOT NULL GROUP BY 1")
def unit_ratio(spark, folder):
    c = read(spark, folder, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("a"), (F.col("c_nationkey") + 1).alias("b"))
    return stats.unit_ratio(c, "c_nationkey", ["a"], ["b"]).withColumn("ratio", F.round("ratio", 6))


@query(
    """SELECT motive, h AS hour, round((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY motive), 6) AS share
FROM (SELECT DISTINCT motive FROM diary) CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT motive, start // 60 AS h, count(*) AS n FROM diary GROUP BY 1, 2) USING (motive, h)""",
    diary=True,
)
def smoothed_crosstab(spark, folder):
    d = diary(spark, folder).withColumn("hour", F.floor(F.col("start") / 60))
    return stats.smoothed_crosstab(d, "motive", "hour").withColumn("share", F.round("share", 6))


@query(
    """SELECT count(*) AS blocks, round(quantile_cont(rate, 0.5), 6) AS q50, round(quantile_cont(rate, 0.75), 6) AS q75, round(quantile_cont(rate, 0.9), 6) AS q90, round(quantile_cont(rate, 0.99), 6) AS q99
FROM (SELECT avg((motive = 'error')::INT) AS rate FROM diary GROUP BY hh, day)""",
    diary=True,
)
def block_rates(spark, folder):
    out = stats.block_rates(diary(spark, folder).withColumn("bad", (F.col("motive") == "error").cast("int")), ["hh", "day"], "bad")
    return out.select("blocks", *[F.round(q, 6).alias(q) for q in ("q50", "q75", "q90", "q99")])


@query(
    """WITH p AS (SELECT (l_returnflag = 'R')::INT AS y, CAST(l_linenumber AS DOUBLE) / 8 AS p, CAST(l_quantity AS BIGINT) AS w FROM lineitem)
SELECT CAST(greatest(ceil(p * 10), 1) AS BIGINT) AS bin, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight, round(sum(w * y) / sum(w), 6) AS observed, round(sum(w * p) / sum(w), 6) AS predicted FROM p GROUP BY 1"""
)
def reliability_table(spark, folder):
    p = read(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber").cast("double") / 8).alias("p"), F.col("l_quantity").cast("long").alias("w"))
    out = stats.reliability_table(p, "y", "p", "w")
    return out.select("bin", "n", "weight", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"))


@query(
    """WITH p AS (SELECT o_orderpriority AS g, o_custkey AS c, CAST(1 + o_orderkey % 5 AS BIGINT) AS w, (o_orderstatus = 'F')::INT AS y FROM orders),
s AS (SELECT g, sum(w * y) / sum(w) AS share, sum(w) AS ww FROM p GROUP BY g),
z AS (SELECT g, c, share, ww, sum(w * (y - share)) AS z FROM p JOIN s USING (g) GROUP BY g, c, share, ww)
SELECT g, round(max(share), 6) AS share, round(count(*) / (count(*) - 1) * sum(z * z) / max(ww) ** 2, 9) AS variance FROM z GROUP BY g"""
)
def cluster_shares(spark, folder):
    p = read(spark, folder, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("c"), (1 + F.col("o_orderkey") % 5).alias("w"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return stats.cluster_shares(p, "y", "w", "c", "g").select("g", F.round("share", 6).alias("share"), F.round("variance", 9).alias("variance"))


@query(
    """WITH p AS (SELECT o_orderpriority AS st, o_custkey AS c, 1 + o_orderkey % 5 AS w, (o_orderstatus = 'F')::INT AS y FROM orders),
t AS (SELECT sum(w) AS ww, sum(w * y) AS yy FROM p), z AS (SELECT st, c, (sum(w * y) - max(yy) / max(ww) * sum(w)) / max(ww) AS z FROM p, t GROUP BY st, c),
v AS (SELECT count(*) * var_samp(z) AS v FROM z GROUP BY st HAVING count(*) > 1)
SELECT round((SELECT yy / ww FROM t), 6) AS share, round(sqrt(sum(v)), 9) AS se FROM v"""
)
def stratified_share(spark, folder):
    p = read(spark, folder, "orders").select(F.col("o_orderpriority").alias("st"), F.col("o_custkey").alias("c"), (1 + F.col("o_orderkey") % 5).alias("w"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return stats.stratified_share(p, "y", "w", "st", "c").select(F.round("share", 6).alias("share"), F.round("se", 9).alias("se"))


@query(
    """WITH n AS (SELECT c_custkey, count(o_orderkey) AS trips FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT trips, count(*) AS persons, round(sum(count(*)) OVER (ORDER BY trips) / (SELECT count(*) FROM n), 6) AS cumulative FROM n GROUP BY trips"""
)
def trips_per_person(spark, folder):
    persons = read(spark, folder, "customer").select("c_custkey")
    trips = read(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return stats.trips_per_person(persons, trips, ["c_custkey"]).withColumn("cumulative", F.round("cumulative", 6))


@query(
    """WITH p AS (SELECT l_returnflag AS t, CASE WHEN l_linenumber <= 2 THEN 'R' WHEN l_linenumber <= 4 THEN 'A' ELSE 'N' END AS g, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
c AS (SELECT t AS class FROM p UNION SELECT g FROM p)
SELECT class, CAST(s AS BIGINT) AS support, round(h / q, 6) AS precision, round(h / s, 6) AS recall, round(2 * h / (q + s), 6) AS f1 FROM (
  SELECT class, (SELECT sum(w) FROM p WHERE t = class) AS s, (SELECT sum(w) FROM p WHERE g = class) AS q, (SELECT sum(w) FROM p WHERE t = class AND g = class) AS h FROM c)"""
)
def classifier_metrics(spark, folder):
    guess = F.when(F.col("l_linenumber") <= 2, "R").when(F.col("l_linenumber") <= 4, "A").otherwise("N")
    p = read(spark, folder, "lineitem").select("l_returnflag", guess.alias("g"), F.col("l_quantity").cast("long").alias("w"))
    return stats.confusion(p, "l_returnflag", "g", "w").select("class", F.col("support").cast("long").alias("support"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS b, o_orderpriority = '1-URGENT' AS u, 1 + o_orderkey % 4 AS w FROM orders)
SELECT 'a' AS feature, round(sum(w) FILTER (NOT u AND a IS NULL) / sum(w) FILTER (NOT u), 6) AS known_missing, round(sum(w) FILTER (u AND a IS NULL) / sum(w) FILTER (u), 6) AS unknown_missing FROM p
UNION ALL SELECT 'b', round(sum(w) FILTER (NOT u AND b IS NULL) / sum(w) FILTER (NOT u), 6), round(sum(w) FILTER (u AND b IS NULL) / sum(w) FILTER (u), 6) FROM p"""
)
def feature_missingness(spark, folder):
    p = read(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")).alias("b"),
        (F.col("o_orderpriority") == "1-URGENT").alias("u"), (1 + F.col("o_orderkey") % 4).alias("w"),
    )
    return stats.feature_missingness(p, ["a", "b"], "u", "w").select("feature", *[F.round(c, 6).alias(c) for c in ("known_missing", "unknown_missing")])


@query(
    """SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS "distinct", CAST(min(o_custkey) AS DOUBLE) AS low, CAST(median(o_custkey) AS DOUBLE) AS median, CAST(max(o_custkey) AS DOUBLE) AS high, 0 AS nulls FROM orders
UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey), min(o_orderkey), median(o_orderkey), max(o_orderkey), 0 FROM orders"""
)
def column_profile(spark, folder):
    return stats.column_profile(read(spark, folder, "orders"), ["o_custkey", "o_orderkey"])


@query(
    """WITH p AS (SELECT c_custkey, c_nationkey, c_custkey % 50 + 1 AS v, c_custkey % 3 = 0 AS s, 1000.0 * (c_nationkey + 1) AS t FROM customer)
SELECT c_custkey, round(CASE WHEN s THEN t * v / sum(v) FILTER (s) OVER (PARTITION BY c_nationkey) ELSE 0 END, 6) AS allocated FROM p"""
)
def allocate_to_sampled(spark, folder):
    p = read(spark, folder, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 50 + 1).alias("v"), (F.col("c_custkey") % 3 == 0).alias("s"), (1000.0 * (F.col("c_nationkey") + 1)).alias("t"))
    return stats.allocate(p, "c_nationkey", "v", "t", "s").select("c_custkey", F.round("allocated", 6).alias("allocated"))


@query(
    """WITH p AS (SELECT c_custkey, c_nationkey, c_custkey % 13 AS score, 1 + c_custkey % 4 AS w FROM customer),
q AS (SELECT *, (sum(w) OVER (PARTITION BY c_nationkey ORDER BY score, c_custkey) - w / 2.0) / sum(w) OVER (PARTITION BY c_nationkey) AS rank FROM p)
SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN CAST((0.2 <= rank)::INT + (0.5 <= rank)::INT + (0.9 <= rank)::INT AS BIGINT) END AS level FROM q"""
)
def rank_calibrate(spark, folder):
    p = read(spark, folder, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 13).alias("score"), (1 + F.col("c_custkey") % 4).alias("w"))
    bounds = read(spark, folder, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.9)).alias("cumulative"))
    return stats.rank_calibrate(p, ["c_nationkey"], "score", "c_custkey", "w", bounds, "c_nationkey").select("c_custkey", "level")
