"""Registered queries on zones, imputation, revisions and the model tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripmill.operators import chains, imputation, revisions, tables, zones
from tripmill.sources.tables import read

from .queries import BACK, DAY, diary, query, r

# -- chains -----------------------------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN motive = 'signup' AND dest <> home THEN CASE dest WHEN 0 THEN 'view' WHEN 1 THEN 'purchase' ELSE 'other' END ELSE motive END AS motive FROM diary""",
    diary=True,
)
def recode_returns(spark, folder):
    return chains.recode_returns(diary(spark, folder), BACK, {0: "view", 1: "purchase"}, "other").select("event_id", "motive")


@query("SELECT event_id, CASE WHEN motive = 'signup' AND dest = origin AND origin <> home THEN home ELSE dest END AS dest FROM diary", diary=True)
def returns_copying_origin(spark, folder):
    return chains.returns_copying_origin(diary(spark, folder), BACK).select("event_id", "dest")


@query(
    """, usual AS (SELECT person, dest, motive AS usual FROM (SELECT person, dest, motive, row_number() OVER (PARTITION BY person, dest ORDER BY count(*) DESC, motive) AS n
  FROM diary WHERE motive <> 'signup' GROUP BY person, dest, motive) WHERE n = 1)
SELECT event_id, CASE WHEN motive = 'signup' AND dest <> home THEN coalesce(usual, motive) ELSE motive END AS motive FROM diary LEFT JOIN usual USING (person, dest)""",
    diary=True,
)
def returns_elsewhere(spark, folder):
    return chains.returns_elsewhere(diary(spark, folder), "person", BACK).select("event_id", "motive")


@query(
    """, a AS (SELECT *, coalesce(trip = 1 AND origin <> home AND dest = home AND lead(origin) OVER w = home, false) AS rotated FROM
  (SELECT * REPLACE (CASE WHEN trip = 1 THEN (home + 1) % 5 ELSE origin END AS origin) FROM diary) WINDOW w AS (PARTITION BY person, day ORDER BY trip)),
b AS (SELECT *, CASE WHEN lag(rotated) OVER w THEN lag(origin) OVER w END AS place FROM a WINDOW w AS (PARTITION BY person, day ORDER BY trip))
SELECT event_id, CASE WHEN rotated THEN home ELSE coalesce(place, origin) END AS origin, CASE WHEN rotated THEN origin ELSE dest END AS dest, rotated FROM b""",
    diary=True,
)
def rotated_first_trips(spark, folder):
    away = diary(spark, folder).withColumn("origin", F.when(F.col("trip") == 1, (F.col("home") + 1) % 5).otherwise(F.col("origin")))
    return chains.rotated_first_trips(away, DAY).select("event_id", "origin", "dest", "rotated")


@query(
    """SELECT event_id, CASE WHEN motive = 'signup' AND dest = home AND minutes - gap > 15 AND gap >= 0.5 * minutes THEN gap ELSE minutes END AS minutes
FROM (SELECT *, lead(start) OVER (PARTITION BY person, day ORDER BY trip) - start AS gap FROM diary)""",
    diary=True,
)
def cap_rides_home(spark, folder):
    return chains.cap_rides_home(diary(spark, folder), DAY, BACK).select("event_id", "minutes")


@query(
    """, f AS (SELECT *, lag(start) OVER w AS prev_start, lead(start) OVER w AS next_start, lag(start + minutes) OVER w AS prev_arrival,
  last_value(motive IGNORE NULLS) OVER (PARTITION BY person, day, dest ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_place_motive,
  coalesce(sum((motive IN ('purchase'))::INT) OVER (PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS after_mandatory
  FROM diary WINDOW w AS (PARTITION BY person, day ORDER BY trip))
SELECT event_id, prev_start, next_start, prev_arrival, same_place_motive, after_mandatory, trip = 1 AS is_first, round(ln(1 + minutes), 6) AS log_minutes,
  coalesce(next_start - start - minutes >= 0 AND (prev_arrival IS NULL OR start >= prev_arrival - 15), false) AS donor FROM f""",
    diary=True,
)
def trip_features_donors(spark, folder):
    d = chains.donor_mask(chains.trip_features(diary(spark, folder), DAY, ["purchase"]))
    names = ("event_id", "prev_start", "next_start", "prev_arrival", "same_place_motive", "after_mandatory", "is_first")
    return d.select(*names, r(F.col("log_minutes"), "log_minutes"), "donor")


@query(
    """, x AS (SELECT *, count(*) OVER p AS n, CASE WHEN person % 3 = 0 THEN 600 + person END AS total, sum(minutes) OVER p AS own FROM diary WINDOW p AS (PARTITION BY person, day)),
f AS (SELECT *, (total - n) * CASE WHEN own > 0 THEN minutes / own ELSE 1 / n END AS x FROM x),
g AS (SELECT *, floor(round(x, 9)) AS fl, round(x - floor(round(x, 9)), 9) AS re FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY re DESC, trip) <= total - n - sum(fl) OVER (PARTITION BY person, day) AS more FROM g)
SELECT event_id, CAST(CASE WHEN total IS NOT NULL THEN 1 + fl + more::INT ELSE minutes END AS BIGINT) AS minutes FROM h""",
    diary=True,
)
def correct_minutes(spark, folder):
    d = diary(spark, folder).withColumn("total", F.when(F.col("person") % 3 == 0, 600 + F.col("person")))
    return chains.spread_minutes(d, DAY, "trip", "minutes", "total").select("event_id", "minutes")


# -- zones ------------------------------------------------------------------------------

ENDS = """e AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, 'dest' AS source, CAST(l_partkey % 7 AS BIGINT) AS zone FROM lineitem
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'dwelling', CAST(s_nationkey % 7 AS BIGINT) FROM supplier),
codes AS (SELECT code, source, zone, count(*) AS n FROM e WHERE NOT starts_with(code, '9') GROUP BY ALL)"""


def _codes(spark, folder):
    ends = read(spark, folder, "lineitem").select(F.col("l_suppkey").alias("code"), (F.col("l_partkey") % 7).cast("long").alias("zone"))
    own = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("code"), (F.col("s_nationkey") % 7).cast("long").alias("zone"))
    return zones.survey_codes({"dest": ends, "dwelling": own}, ["9"])


@query(f"WITH {ENDS} SELECT * FROM codes")
def survey_codes(spark, folder):
    return _codes(spark, folder)


DOMINANT = """t AS (SELECT code, zone, CAST(sum(n) AS BIGINT) AS n FROM codes GROUP BY ALL),
dom AS (SELECT code, zone, n, n_zones FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n_zones, row_number() OVER (PARTITION BY code ORDER BY n DESC, zone) AS k FROM t) WHERE k = 1)"""


@query(f"WITH {ENDS}, {DOMINANT} SELECT * FROM dom")
def dominant_zone(spark, folder):
    return zones.dominant_zone(_codes(spark, folder))


@query(
    f"""WITH {ENDS}, {DOMINANT} SELECT CASE WHEN s_suppkey IS NOT NULL THEN 'access' WHEN d.zone IS NULL THEN 'unknown' WHEN d.zone = e.zone THEN 'in_zone' ELSE 'other_zone' END AS status,
  count(*) AS n FROM e LEFT JOIN dom d USING (code) LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 = 0) ON CAST(s_suppkey AS VARCHAR) = code WHERE source = 'dest' GROUP BY 1"""
)
def trip_end_agreement(spark, folder):
    ends = read(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("code"), (F.col("l_partkey") % 7).cast("long").alias("zone"))
    access = read(spark, folder, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("string").alias("code"))
    return zones.trip_end_agreement(ends, zones.dominant_zone(_codes(spark, folder)), access)


@query(
    """WITH p AS (SELECT c_nationkey, o_custkey % 4 AS zone, count(*) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, zone, round(p / t, 6) AS share, k > 1 AS straddles FROM (SELECT *, sum(p) OVER w AS t, count(*) OVER w AS k,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY p DESC, zone) AS n FROM p WINDOW w AS (PARTITION BY c_nationkey)) WHERE n = 1"""
)
def population_majority_zone(spark, folder):
    who = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    blocks = read(spark, folder, "orders").join(who, "o_custkey").select("c_nationkey", (F.col("o_custkey") % 4).alias("zone"), F.lit(1).alias("people"))
    return zones.majority_zone(blocks, "c_nationkey", "zone", "people").withColumn("share", F.round("share", 6))


@query(
    """SELECT c_custkey, n_nationkey AS zone FROM (SELECT c_custkey, (c_custkey * 37 % 1000) / 100 + 0.003 AS x, (c_custkey * 71 % 1000) / 100 + 0.004 AS y FROM customer)
JOIN (SELECT n_nationkey, n_nationkey % 5 * 2 + 1.3 AS cx, n_nationkey // 5 * 2 + 1.1 AS cy FROM nation) ON abs(x - cx) + abs(y - cy) < 0.9"""
)
def point_in_polygon(spark, folder):
    at = lambda k: (F.col("c_custkey") * k % 1000) / 100
    points = read(spark, folder, "customer").select("c_custkey", (at(37) + 0.003).alias("x"), (at(71) + 0.004).alias("y"))
    cx, cy = F.col("n_nationkey") % 5 * 2 + 1.3, F.floor(F.col("n_nationkey") / 5) * 2 + 1.1
    corner = lambda dx, dy: F.struct((cx + dx).cast("double").alias("x"), (cy + dy).cast("double").alias("y"))
    ring = F.array(corner(-0.9, 0.0), corner(0.0, 0.9), corner(0.9, 0.0), corner(0.0, -0.9))
    diamonds = read(spark, folder, "nation").select(F.col("n_nationkey").alias("zone"), ring.alias("ring"))
    return zones.point_in_polygon(points, diamonds).select("c_custkey", "zone")


YEARS = "SELECT o_orderpriority, year(o_orderdate) AS y, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS v, o_orderstatus, o_custkey % 9 AS zone FROM orders"


def _years(spark, folder):
    o = read(spark, folder, "orders")
    value = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    return o.select("o_orderpriority", F.year("o_orderdate").alias("y"), value.alias("v"), "o_orderstatus", (F.col("o_custkey") % 9).alias("zone"))


@query(
    f"""SELECT o_orderpriority, round(b, 2) AS base_total, round(t, 2) AS target_total, round(t / CASE WHEN b > 0 THEN b END, 6) AS ratio FROM
  (SELECT o_orderpriority, sum(v) FILTER (y = 1996) AS b, sum(v) FILTER (y = 1997) AS t FROM ({YEARS}) WHERE y IN (1996, 1997) GROUP BY 1)"""
)
def growth_ratio(spark, folder):
    out = zones.growth_ratio(_years(spark, folder), ["o_orderpriority"], "y", "v", 1996, 1997)
    return out.select("o_orderpriority", F.round("base_total", 2).alias("base_total"), F.round("target_total", 2).alias("target_total"), r(F.col("ratio"), "ratio"))


@query(f"SELECT zone, y, round(sum(v), 2) AS v FROM (SELECT zone * 100 + y % 100 AS zone, y, v FROM ({YEARS})) GROUP BY zone, y")
def zone_targets(spark, folder):
    d = _years(spark, folder).withColumn("cell", F.struct((F.col("zone") * 100 + F.col("y") % 100).alias("zone"), "y"))
    return zones.zone_targets(d, "cell", ["v"]).select("cell.*", F.round("v", 2).alias("v"))


@query(f"SELECT zone, round(sum(CASE WHEN o_orderstatus = 'O' THEN v ELSE 0 END) / nullif(sum(v), 0), 6) AS coverage FROM ({YEARS}) GROUP BY zone")
def coverage(spark, folder):
    return zones.coverage(_years(spark, folder), "zone", F.col("o_orderstatus") == "O", "v").withColumn("coverage", F.round("coverage", 6))


@query(
    """WITH rec AS (SELECT o_custkey % 9 AS zone, 1 + o_orderkey % 3 AS w, (o_orderstatus = 'O')::INT AS open, (o_orderpriority = '1-URGENT')::INT AS urgent FROM orders),
c AS (SELECT zone, 'open' AS "constraint", sum(w * open) AS estimate, count(*) FILTER (open > 0) AS supporting FROM rec GROUP BY 1
  UNION ALL SELECT zone, 'open_urgent', sum(w * open * urgent), count(*) FILTER (open * urgent > 0) FROM rec GROUP BY 1),
t AS (SELECT range AS zone, k AS "constraint", 100.0::DOUBLE + range AS target FROM range(11), (VALUES ('open'), ('open_urgent')) v(k))
SELECT zone, "constraint", target, coalesce(estimate, 0)::DOUBLE AS estimate, coalesce(supporting, 0) AS supporting, round(coalesce(estimate, 0) / target, 6) AS ratio FROM t LEFT JOIN c USING (zone, "constraint")"""
)
def target_diagnostic(spark, folder):
    records = read(spark, folder, "orders").select(
        (F.col("o_custkey") % 9).alias("zone"), (1 + F.col("o_orderkey") % 3).alias("w"), (F.col("o_orderstatus") == "O").cast("int").alias("open"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
    )
    wanted = spark.range(11).select(F.col("id").alias("zone"), F.explode(F.array(F.lit("open"), F.lit("open_urgent"))).alias("constraint"))
    wanted = wanted.withColumn("target", 100.0 + F.col("zone"))
    out = zones.target_diagnostic(records, "zone", "w", {"open": ["open"], "open_urgent": ["open", "urgent"]}, wanted)
    return out.withColumn("ratio", F.round("ratio", 6))


@query(
    """WITH m AS (SELECT o_orderkey % 50 AS area, o_orderkey AS hh, md5(string_agg(o_orderpriority || '|' || o_orderstatus, ';' ORDER BY o_orderpriority || '|' || o_orderstatus)) AS roster FROM orders GROUP BY 1, 2)
SELECT area, roster, count(*) AS households, min(hh) AS first_hh FROM m GROUP BY area, roster HAVING count(*) > 1"""
)
def duplicate_rosters(spark, folder):
    m = read(spark, folder, "orders").select((F.col("o_orderkey") % 50).alias("area"), F.col("o_orderkey").alias("hh"), "o_orderpriority", "o_orderstatus")
    return zones.duplicate_rosters(m, "area", "hh", ["o_orderpriority", "o_orderstatus"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)")
def persons_with_leg(spark, folder):
    legs = read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return zones.persons_with_leg(read(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), legs, ["o_orderkey"], "l_returnflag = 'R' AND l_quantity > 40")


@query(
    """SELECT c_custkey, draw, CAST(c_nationkey % 4 + coalesce(n, 0) AS BIGINT) AS members FROM customer CROSS JOIN (SELECT range AS draw FROM range(1, 4))
LEFT JOIN (SELECT o_custkey AS c_custkey, o_orderkey % 3 + 1 AS draw, sum((o_orderstatus = 'O')::INT) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2) USING (c_custkey, draw)"""
)
def member_count_per_draw(spark, folder):
    told = read(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") % 4).cast("long").alias("n"))
    drawn = read(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3 + 1).alias("draw"), (F.col("o_orderstatus") == "O").cast("int").alias("v"), "o_totalprice"
    )
    return zones.member_count(told, drawn, "c_custkey", 3, "v", "n", "o_totalprice > 1000")


# -- imputation -------------------------------------------------------------------------

UNIFORM = "CAST(CAST('0x' || substr(md5(concat_ws('|', {})), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
DRAWS = (
    """d AS (SELECT o_orderkey, draw, o_orderpriority, 0.2 + (o_orderkey % 5) / 10 AS p_a, 0.1 + (o_custkey % 7) / 10 AS q_a, 0.05 + (o_custkey % 3) / 4 AS q_b FROM orders, range(1, 6) v(draw)),
u AS (SELECT *, """ + UNIFORM.format("o_orderkey, draw, 0, 17") + " AS u0, " + UNIFORM.format("o_orderkey, draw, 1, 17") + """ AS u1 FROM d),
a AS (SELECT *, CASE WHEN u0 < p_a THEN 'a' ELSE 'b' END AS job FROM u),
draws AS (SELECT o_orderkey, draw, job, CASE WHEN u1 < CASE job WHEN 'a' THEN q_a ELSE q_b END THEN 'x' ELSE 'y' END AS class FROM a)"""
)


def _probabilities(spark, folder):
    o = read(spark, folder, "orders")
    p_a, q_a, q_b = 0.2 + (F.col("o_orderkey") % 5) / 10, 0.1 + (F.col("o_custkey") % 7) / 10, 0.05 + (F.col("o_custkey") % 3) / 4
    return o.select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", p_a.alias("p_a"), (1 - p_a).alias("p_b"), q_a.alias("q_a"),
        (1 - q_a).alias("q_a_y"), q_b.alias("q_b"), (1 - q_b).alias("q_b_y"),
    )


def _draws(spark, folder):
    steps = [("job", ["a", "b"], {None: ["p_a", "p_b"]}), ("class", ["x", "y"], {"a": ["q_a", "q_a_y"], "b": ["q_b", "q_b_y"]})]
    return imputation.chain_draws(_probabilities(spark, folder), "o_orderkey", 5, 17, steps).select("o_orderkey", "draw", "job", "class")


@query(f"WITH {DRAWS} SELECT * FROM draws")
def chain_draws(spark, folder):
    return _draws(spark, folder)


@query(f"WITH {DRAWS} SELECT o_orderkey, class, count(*) / 5 AS prob FROM draws GROUP BY 1, 2")
def aggregate_over_draws(spark, folder):
    return imputation.level_per_draw(_draws(spark, folder), ["o_orderkey"], "class")


@query(
    f"""WITH {DRAWS}, s AS (SELECT draw, class, count(*) / sum(count(*)) OVER (PARTITION BY draw) AS s FROM draws GROUP BY 1, 2)
SELECT class, round(sum(s) / 5, 6) AS mean, round(sqrt(greatest((sum(s * s) - 5 * (sum(s) / 5) ** 2) / 4, 0)), 6) AS sd FROM s GROUP BY 1"""
)
def monte_carlo_error(spark, folder):
    d = imputation.draw_spread(_draws(spark, folder).withColumn("w", F.lit(1)), "draw", "class", "w")
    return d.select("class", r(F.col("mean"), "mean"), r(F.col("sd"), "sd"))


@query(
    """SELECT o_orderkey, round(p_a * q_a + (1 - p_a) * q_b, 6) AS marginal, CAST((p_a > 0)::INT + (1 - p_a > 0)::INT AS BIGINT) AS scenarios,
  concat_ws('+', CASE WHEN p_a > 0 THEN 'a' END, CASE WHEN 1 - p_a > 0 THEN 'b' END) AS names
FROM (SELECT o_orderkey, (o_orderkey % 5) / 4 AS p_a, 0.1 + (o_custkey % 7) / 10 AS q_a, 0.05 + (o_custkey % 3) / 4 AS q_b FROM orders)"""
)
def chain_enumerate(spark, folder):
    d = _probabilities(spark, folder).withColumn("p_a", (F.col("o_orderkey") % 5) / 4).withColumn("p_b", 1 - F.col("p_a"))
    return imputation.chain_enumerate(d, "o_orderkey", {"a": "p_a", "b": "p_b"}, {"a": "q_a", "b": "q_b"}).withColumn("marginal", F.round("marginal", 6))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0 THEN 'full' WHEN o_orderkey % 3 <> 0 THEN 'short' END AS arm FROM orders"""
)
def assign_arms(spark, folder):
    d = read(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, 1).alias("f1"), F.when(F.col("o_custkey") % 4 != 0, 1).alias("f2"))
    return imputation.assign_arms(d, [("full", ["f1", "f2"]), ("short", ["f1"])]).select("o_orderkey", "arm")


@query(
    """SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'full' ELSE 'short' END AS arm, count(*) AS "rows", CAST(sum(1 + o_custkey % 5) AS BIGINT) AS total,
  round(sum(1 + o_custkey % 5) / (SELECT sum(1 + o_custkey % 5) FROM orders), 6) AS share FROM orders GROUP BY 1"""
)
def imputation_usage(spark, folder):
    arm = F.when(F.col("o_orderkey") % 3 != 0, "full").otherwise("short")
    d = read(spark, folder, "orders").select(arm.alias("arm"), (1 + F.col("o_custkey") % 5).alias("w"))
    return imputation.usage(d, "arm", "w").withColumn("share", F.round("share", 6))


@query(
    """SELECT o_orderkey, CAST(a + b AS BIGINT) AS points, CASE WHEN a + b < 3 THEN 'low' WHEN a + b < 6 THEN 'middle' WHEN a + b IS NOT NULL THEN 'high' END AS level
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 3 END AS a, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 0 END AS b FROM orders)"""
)
def derive_points_level(spark, folder):
    scores = {"o_orderstatus": {"O": 1, "F": 3}, "o_orderpriority": {"1-URGENT": 4, "2-HIGH": 2, "3-MEDIUM": 1, "5-LOW": 0}}
    return imputation.points(read(spark, folder, "orders"), scores, [(3, "low"), (6, "middle")], "high").select("o_orderkey", "points", "level")


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey % 3 AS t, count(*) AS n FROM orders GROUP BY ALL),
d AS (SELECT o_custkey, t FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, t) AS k FROM c) WHERE k = 1),
h AS (SELECT *, md5(concat_ws('|', o_custkey, '5')) AS h FROM d)
SELECT o_custkey, (row_number() OVER (PARTITION BY t, substr(h, 1, 2) ORDER BY h, o_custkey) - 1) % 4 AS fold FROM h"""
)
def grouped_split(spark, folder):
    return imputation.grouped_split(read(spark, folder, "orders").withColumn("t", F.col("o_orderkey") % 3), "o_custkey", "t", 4, 5)


@query("SELECT count(*) AS \"rows\", count(*) FILTER (o_orderkey % 8 = 0) AS bad FROM orders")
def validate_probability_rows(spark, folder):
    p = (F.col("o_orderkey") % 7) / 7
    d = read(spark, folder, "orders").select(p.alias("a"), (1 - p + F.when(F.col("o_orderkey") % 8 == 0, 0.01).otherwise(0.0)).alias("b"))
    return imputation.bad_probability_rows(d, ["a", "b"])


@query(
    "SELECT replicate, n_nationkey, count(*) AS times FROM (SELECT k // 25 + 1 AS replicate, CAST(floor(" + UNIFORM.format("k // 25 + 1, k % 25, 3")
    + " * 25) AS BIGINT) AS g FROM range(500) v(k)) JOIN nation ON g = n_nationkey GROUP BY ALL"
)
def cluster_bootstrap(spark, folder):
    groups = read(spark, folder, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("id"))
    return imputation.cluster_bootstrap(groups, "n_nationkey", "id", groups.count(), 20, 3)


@query(
    """SELECT count(*) AS "rows", round(avg((p = q)::INT), 6) AS agreement FROM (SELECT 0.2 + (o_orderkey % 5) / 10 < 1 - (0.2 + (o_orderkey % 5) / 10) AS p,
  0.1 + (o_custkey % 7) / 10 < 1 - (0.1 + (o_custkey % 7) / 10) AS q FROM orders)"""
)
def variant_agreement(spark, folder):
    d = _probabilities(spark, folder)
    a = d.select("o_orderkey", F.col("p_a").alias("a"), F.col("p_b").alias("b"))
    b = d.select("o_orderkey", F.col("q_a").alias("a"), F.col("q_a_y").alias("b"))
    return imputation.variant_agreement(a, b, "o_orderkey", ["a", "b"]).withColumn("agreement", F.round("agreement", 6))


@query(
    """WITH e AS (SELECT o_orderstatus AS by_, o_custkey % 20 AS d, avg(o_totalprice / 1000) AS q, var_samp(o_totalprice / 1000) / count(*) AS u FROM orders GROUP BY 1, 2),
s AS (SELECT by_, count(*) AS m, avg(q) AS mean, avg(u) AS within, var_samp(q) AS between_ FROM e GROUP BY 1)
SELECT by_ AS o_orderstatus, m, round(mean, 6) AS mean, round(within, 6) AS within, round(between_, 6) AS between, round(within + (1 + 1 / m) * between_, 6) AS total,
  round((m - 1) * (1 + within / ((1 + 1 / m) * between_)) ** 2, 2) AS df FROM s"""
)
def rubin(spark, folder):
    value = F.col("o_totalprice") / 1000
    e = read(spark, folder, "orders").groupBy("o_orderstatus", (F.col("o_custkey") % 20).alias("d")).agg(F.avg(value).alias("q"), (F.var_samp(value) / F.count("*")).alias("u"))
    out = imputation.rubin(e, "o_orderstatus", "q", "u")
    return out.select("o_orderstatus", "m", *[r(F.col(c), c) for c in ("mean", "within", "between", "total")], F.round("df", 2).alias("df"))


@query("WITH c AS (SELECT sum(l_quantity) AS w FROM lineitem GROUP BY l_returnflag) SELECT round(ln(sum(w)) - sum(w * ln(w)) / sum(w), 6) AS log_loss FROM c")
def marginal_log_loss(spark, folder):
    return imputation.marginal_log_loss(read(spark, folder, "lineitem"), "l_returnflag", "l_quantity").withColumn("log_loss", F.round("log_loss", 6))


# -- revisions --------------------------------------------------------------------------

DECISIONS = """dec AS (SELECT c_custkey, 'c_nationkey' AS field, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS before,
    CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey ELSE 99 END AS VARCHAR) AS after FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 'NEW' FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 'drop', '', 'yes' FROM customer WHERE c_custkey % 13 = 0
  UNION ALL SELECT -c_custkey, 'c_mktsegment', c_mktsegment, 'NEW' FROM customer WHERE c_custkey % 31 = 0)"""


def _decisions(spark, folder):
    c, k, n = read(spark, folder, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    text = lambda x: x.cast("string")
    row = lambda key, field, before, after: (key.alias("c_custkey"), F.lit(field).alias("field"), before.alias("before"), after.alias("after"))
    zone = c.where("c_custkey % 2 = 0").select(*row(k, "c_nationkey", text(F.when(k % 3 == 0, n + 1).otherwise(n)), text(F.when(k % 5 == 0, n).otherwise(99))))
    segment = c.where("c_custkey % 7 = 0").select(*row(k, "c_mktsegment", F.col("c_mktsegment"), F.lit("NEW")))
    drops = c.where("c_custkey % 13 = 0").select(*row(k, "drop", F.lit(""), F.lit("yes")))
    lost = c.where("c_custkey % 31 = 0").select(*row(-k, "c_mktsegment", F.col("c_mktsegment"), F.lit("NEW")))
    return zone.unionByName(segment).unionByName(drops).unionByName(lost)


@query(
    f"""WITH {DECISIONS} SELECT d.c_custkey, field, CASE WHEN c.c_custkey IS NULL THEN 'problem' WHEN v IS NOT DISTINCT FROM after THEN 'holds' WHEN v IS NOT DISTINCT FROM before THEN 'apply' ELSE 'stale' END AS outcome
FROM (SELECT * FROM dec WHERE field <> 'drop') d LEFT JOIN customer c USING (c_custkey), LATERAL (SELECT CASE field WHEN 'c_nationkey' THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS v)"""
)
def decision_outcomes(spark, folder):
    return revisions.decision_outcomes(_decisions(spark, folder).where("field <> 'drop'"), read(spark, folder, "customer"), "c_custkey", ["c_nationkey", "c_mktsegment"])


@query(
    f"""WITH {DECISIONS} SELECT c_custkey, CAST(coalesce((SELECT max(after) FROM dec d WHERE d.c_custkey = c.c_custkey AND field = 'c_nationkey'), CAST(c_nationkey AS VARCHAR)) AS BIGINT) AS c_nationkey,
  CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer c WHERE c_custkey % 13 <> 0"""
)
def apply_decisions(spark, folder):
    rows = read(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment")
    return revisions.apply_decisions(rows, _decisions(spark, folder), "c_custkey", ["c_nationkey", "c_mktsegment"])


@query(
    f"""WITH {DECISIONS}, ed AS (SELECT c_custkey, field, before, CASE WHEN c_custkey % 4 = 0 THEN before ELSE 'edit' END AS after FROM dec WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'name', 'old', 'new' FROM customer WHERE c_custkey % 50 = 0)
SELECT c_custkey, field, coalesce(d.before, e.before) AS before, CASE WHEN e.c_custkey IS NOT NULL THEN e.after ELSE d.after END AS after
FROM dec d FULL JOIN ed e USING (c_custkey, field) WHERE coalesce(d.before, e.before) IS DISTINCT FROM CASE WHEN e.c_custkey IS NOT NULL THEN e.after ELSE d.after END"""
)
def merge_decisions(spark, folder):
    kept = _decisions(spark, folder)
    edits = kept.where("c_custkey % 3 = 0").withColumn("after", F.when(F.col("c_custkey") % 4 == 0, F.col("before")).otherwise("edit"))
    new = read(spark, folder, "customer").where("c_custkey % 50 = 0").select("c_custkey", F.lit("name").alias("field"), F.lit("old").alias("before"), F.lit("new").alias("after"))
    return revisions.merge_decisions(kept, edits.unionByName(new), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'rule_a;rule_b' ELSE 'zone:revision' END AS fix FROM customer")
def net_fixes(spark, folder):
    k = F.col("c_custkey") % 4
    d = read(spark, folder, "customer").select("c_custkey", F.lit(10).alias("was"), F.when(k == 0, 10).when(k == 1, 11).otherwise(12).alias("now"), F.lit(11).alias("ruled"), F.lit("rule_a;rule_b").alias("codes"))
    return revisions.net_fixes(d, "was", "now", "ruled", "codes", "zone").select("c_custkey", "fix")


FLAGS = "SELECT o_custkey AS person, concat_ws(';', CASE WHEN o_orderstatus = 'F' THEN 'late' END, CASE WHEN o_orderkey % {} = 0 THEN 'odd' END, CASE WHEN o_totalprice < 50000 THEN 'small' END) AS issues FROM orders"


def _flags(spark, folder, k):
    marks = F.concat_ws(";", F.when(F.col("o_orderstatus") == "F", "late"), F.when(F.col("o_orderkey") % k == 0, "odd"), F.when(F.col("o_totalprice") < 50000, "small"))
    return read(spark, folder, "orders").select(F.col("o_custkey").alias("person"), marks.alias("issues"))


@query(f"SELECT person, count(*) AS marks, bool_or(code IN ('odd')) AS any_of FROM (SELECT person, unnest(string_split(issues, ';')) AS code FROM ({FLAGS.format(9)})) WHERE code <> '' GROUP BY 1")
def marked_persons(spark, folder):
    return revisions.marked_persons(_flags(spark, folder, 9), "person", "issues", ["odd"])


@query(
    f"""WITH a AS (SELECT DISTINCT person, unnest(string_split(issues, ';')) AS code FROM ({FLAGS.format(9)})), b AS (SELECT DISTINCT person, unnest(string_split(issues, ';')) AS code FROM ({FLAGS.format(6)})),
d AS (SELECT *, 'c' AS k FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'm' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT person, coalesce(string_agg(code, ';' ORDER BY code) FILTER (k = 'c'), '') AS cleared, coalesce(string_agg(code, ';' ORDER BY code) FILTER (k = 'm'), '') AS made FROM d WHERE code <> '' GROUP BY 1"""
)
def verify_edits(spark, folder):
    return revisions.verify_edits(_flags(spark, folder, 9), _flags(spark, folder, 6), "person", "issues")


# -- model tables -----------------------------------------------------------------------


@query(
    """SELECT c_custkey, CAST(greatest(c_nationkey % 6, coalesce(n, 0)) AS BIGINT) AS size, CAST(c_custkey % 3 + coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END, 0) AS BIGINT) AS vehicles
FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)"""
)
def build_households(spark, folder):
    k = F.col("c_custkey")
    hh = read(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("told"), (k % 3).alias("cars"), F.when(k % 4 > 0, k % 4).alias("motos"))
    members = read(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.build_households(hh, members, "c_custkey", "told", ["cars", "motos"])


@query(
    """SELECT person, day, CASE WHEN person % 3 = 0 THEN 'told' WHEN person % 3 = 1 THEN 'drawn' ELSE 'none' END AS employment,
  min_by(dest, trip) FILTER (motive = 'purchase') AS work_zone FROM diary GROUP BY 1, 2""",
    diary=True,
)
def build_people(spark, folder):
    d = diary(spark, folder)
    k = F.col("person") % 3
    people = d.select("person", "day").distinct().withColumn("told", F.when(k == 0, "told")).withColumn("drawn", F.when(k == 1, "drawn"))
    return tables.build_people(people, d, DAY, "told", "drawn", "none", ["purchase"])


@query(
    """SELECT * FROM (SELECT 'range:l_quantity' AS problem, count(*) FILTER (l_quantity > 45) AS "rows" FROM lineitem UNION ALL
  SELECT 'domain:l_returnflag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL
  SELECT 'null:l_comment_key', count(*) FILTER (l_orderkey % 5 = 0) FROM lineitem UNION ALL
  SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) WHERE "rows" > 0"""
)
def validate_table(spark, folder):
    d = read(spark, folder, "lineitem").withColumn("l_comment_key", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey")))
    return tables.validate_table(d, ["l_orderkey", "l_linenumber"], ["l_comment_key", "l_orderkey"], {"l_quantity": (0, 45)}, {"l_returnflag": ["A", "N"]})


@query(
    """, p AS (SELECT * REPLACE (trip + sum((event_id % 17 = 0)::INT) OVER (PARTITION BY person, day ORDER BY trip) AS trip), CASE WHEN motive = 'signup' THEN 'H' ELSE 'O' END AS pur FROM diary),
q AS (SELECT *, pur = 'H' AND coalesce(lag(pur) OVER (PARTITION BY person, day ORDER BY trip), 'H') = 'H' AS at_home FROM p)
SELECT CAST(sum(h) AS BIGINT) AS home_to_home, count(*) FILTER (NOT (lo = 1 AND hi = n)) AS gaps FROM (SELECT sum(at_home::INT) AS h, max(trip) AS hi, min(trip) AS lo, count(*) AS n FROM q GROUP BY person, day)""",
    diary=True,
)
def table_invariants(spark, folder):
    skipped = F.sum((F.col("event_id") % 17 == 0).cast("int")).over(Window.partitionBy(*DAY).orderBy("trip"))
    d = diary(spark, folder).withColumns({"trip": F.col("trip") + skipped, "pur": F.when(F.col("motive") == BACK, "H").otherwise("O")})
    return tables.table_invariants(d, DAY, "trip", "pur")


@query("SELECT o_orderkey, CAST(1 + c_nationkey % 7 AS DOUBLE) AS expansion FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def household_expansion(spark, folder):
    hh = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (1 + F.col("c_nationkey") % 7).alias("w"))
    return tables.household_expansion(read(spark, folder, "orders").select("o_orderkey", "o_custkey"), hh, "o_custkey", "w", False).select("o_orderkey", "expansion")
