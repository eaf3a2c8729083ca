"""Registered queries on the model tables, their contract and profiles, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripmill.operators import clean, joins, model_tables
from tripmill.operators.model_tables import Codes, Field, PeopleCodes, TripCodes
from tripmill.sources.tables import read

from .issues import wraps_of
from .queries import BACK, DAY, DIARY, diary, query


@query(
    """WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, c_nationkey AS zone, CAST(greatest(CASE WHEN c_nationkey % 5 < 4 THEN c_nationkey % 5 + 1 ELSE 6 END, coalesce(n, 0)) AS BIGINT) AS persons,
  CAST(c_custkey % 3 + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS vehicles, CASE (c_custkey + 2) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 9 END AS income_class,
  CAST(1 + c_custkey % 5 AS DOUBLE) AS expansion FROM customer LEFT JOIN n USING (c_custkey)"""
)
def model_households(spark, folder):
    k = F.col("c_custkey")
    label = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = read(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", label("n", F.col("c_nationkey") % 5).alias("told"), label("v", k % 3).alias("cars"), F.when(k % 4 == 1, "one").when(k % 4 == 2, "none").alias("motos"),
    )
    draws = c.select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("draw")).withColumn("level", label("l", (k + F.col("draw")) % 4))
    weights = c.select("c_custkey", (1 + k % 5).alias("w"))
    members = read(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return model_tables.model_households(
        c, members, draws, 2, "c_custkey", "c_nationkey", ("told", Codes({f"n{i}": i + 1 for i in range(4)}, 6)), {"cars": Codes({"v0": 0, "v1": 1}, 2), "motos": Codes({"one": 1}, 0)},
        ("level", Codes({"l0": 1, "l1": 2, "l2": 3}, 9)), "w", weights,
    )


PEOPLE = PeopleCodes(
    Codes({"work": "F", "rest": "O", "study": "O"}), Codes({"employed": "F", "idle": "O"}), Codes({"shop": "S", "farm": "M"}), Codes({"farm": "M"}),
    informal={"informal": "P"}, student_jobs=["student"], student_answers=["study"],
)


@query(
    """, p AS (SELECT person, day, person % 90 AS age, CASE person % 4 WHEN 0 THEN 'work' WHEN 1 THEN 'study' WHEN 2 THEN 'rest' END AS answer, CASE person % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'M' END AS rep,
    min_by(dest, trip) FILTER (motive = 'purchase') AS wz, min_by(dest, trip) FILTER (motive = 'view') AS sz, coalesce(bool_or(motive = 'view' OR (motive = 'click' AND person % 90 < 12)), false) AS went FROM diary GROUP BY person, day),
q AS (SELECT *, CASE WHEN CASE answer WHEN 'work' THEN 'F' WHEN 'rest' THEN 'O' WHEN 'study' THEN 'O' ELSE CASE (person + 1) % 2 WHEN 0 THEN 'F' ELSE 'O' END END = 'F' THEN CASE WHEN person % 3 = 0 THEN 'P' ELSE 'F' END ELSE 'O' END AS employment FROM p)
SELECT person, day, employment, CASE WHEN employment = 'O' THEN 'O' ELSE coalesce(rep, CASE WHEN person % 2 = 1 THEN 'M' END, 'G') END AS occupation,
  CASE WHEN person % 7 = 0 OR answer = 'study' OR went OR (answer IS NULL AND person % 6 < 3) THEN 'S' ELSE 'O' END AS student, CASE WHEN age >= 18 THEN 'Y' ELSE 'N' END AS license,
  coalesce(wz, 0) AS work_zone, coalesce(sz, 0) AS school_zone, CAST(1 + person % 7 AS DOUBLE) AS expansion FROM q""",
    diary=True,
)
def model_people(spark, folder):
    d, k = diary(spark, folder), F.col("person")
    people = d.select("hh", *DAY).distinct().withColumns(
        {
            "answer": F.when(k % 4 == 0, "work").when(k % 4 == 1, "study").when(k % 4 == 2, "rest"), "sector": F.when(k % 5 == 0, "shop").when(k % 5 == 1, "farm"),
            "job": F.when(k % 7 == 0, "student"), "age": k % 90, "w": 1 + k % 7,
        }
    )
    draws = people.select(*DAY, F.explode(F.sequence(F.lit(1), F.lit(2))).alias("draw")).withColumns(
        {
            "situation": F.when((k + F.col("draw")) % 2 == 0, "employed").otherwise("idle"), "informal": F.when(k % 3 == 0, "informal").otherwise("formal"),
            "sector": F.when(k % 2 == 1, "farm").otherwise("x"), "student": F.when(k % 6 < 3, "S").otherwise("O"),
        }
    )
    return model_tables.model_people(people, d, draws, 1, DAY, PEOPLE, ["purchase"], ["view"], "click", "w", "hh")


TRIPS = TripCodes(
    Codes({"m0": "A", "m1": "B"}, "X"), Codes({"signup": "H", "purchase": "W", "view": "S"}, "O"), Codes({"home": "H", "p1": "W"}, "O"), driven=["m0"], repeats={"W": "R", "S": "C"}
)


@query(
    """, e AS (SELECT *, person % 90 AS age, CASE person % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'p1' ELSE 'p0' END AS answer FROM (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 AND start >= 1080 THEN start - 1080 ELSE start END AS start) FROM diary) WHERE event_id % 20 <> 0)"""
    + wraps_of("e")
    + """, a AS (SELECT *, CASE WHEN motive = 'view' AND age >= 12 THEN 'F' ELSE CASE motive WHEN 'signup' THEN CASE WHEN dest = home THEN 'H' ELSE 'O' END WHEN 'purchase' THEN 'W' WHEN 'view' THEN 'S' ELSE 'O' END END AS p,
    CASE answer WHEN 'home' THEN CASE WHEN origin = home THEN 'H' ELSE 'O' END WHEN 'p1' THEN 'W' ELSE 'O' END AS f FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY person, day, p ORDER BY trip) AS nth FROM a)
SELECT person, day, row_number() OVER w AS trip, CAST(start // 60 * 100 + start % 60 + 2400 * days AS BIGINT) AS start_time, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'P' ELSE CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'X' END END AS mode,
  coalesce(lag(p) OVER w, f) AS origin_purpose, CASE WHEN p = 'W' AND nth > 1 THEN 'R' WHEN p = 'S' AND nth > 1 THEN 'C' ELSE p END AS purpose, origin, dest, minutes AS duration, CAST(weight AS DOUBLE) AS expansion
FROM b WINDOW w AS (PARTITION BY person, day ORDER BY trip)""",
    diary=True,
)
def model_trips(spark, folder):
    event = F.col("event_id")
    d = diary(spark, folder)
    legs = d.select(*DAY, "trip", "minutes")
    d = d.withColumns(
        {
            "start": F.when((event % 5 == 0) & (F.col("start") >= 1080), F.col("start") - 1080).otherwise(F.col("start")), "main": F.concat(F.lit("m"), (event % 3).cast("string")),
            "role": F.when(event % 4 == 0, "passenger").otherwise("driver"), "age": F.col("person") % 90, "is_trip": event % 20 != 0,
            "answer": F.when(F.col("person") % 3 == 0, "home").when(F.col("person") % 3 == 1, "p1").otherwise("p0"),
        }
    )
    return model_tables.model_trips(d, legs, DAY, TRIPS, BACK, ["purchase"], ["purchase"], "view", "weight", "hh")


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS flag, CASE WHEN l_partkey % 9 = 0 THEN -1 WHEN l_partkey % 10 = 0 THEN 0 ELSE l_partkey % 10 END AS zone,
    CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) + CASE WHEN l_suppkey % 2 = 0 THEN 0.5 ELSE 0 END AS half FROM lineitem),
p AS (SELECT 'missing:mode' AS problem, 1 AS rows UNION ALL SELECT 'extra:half', 1 UNION ALL SELECT 'null:flag', count(*) FILTER (flag IS NULL) FROM d UNION ALL SELECT 'domain:flag', count(*) FILTER (flag NOT IN ('A', 'N')) FROM d
  UNION ALL SELECT 'zone:zone', count(*) FILTER (zone = 0) FROM d UNION ALL SELECT 'above:quantity', count(*) FILTER (quantity > 45 AND quantity <> 50) FROM d UNION ALL SELECT 'below:quantity', count(*) FILTER (quantity < 3) FROM d
  UNION ALL SELECT 'duplicate_key', (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM d)))
SELECT problem, rows FROM p WHERE rows > 0"""
)
def check_contract(spark, folder):
    d = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_partkey") % 9 == 0, -1).otherwise(F.col("l_partkey") % 10).alias("zone"), F.col("l_quantity").cast("double").alias("quantity"), F.lit(0.5).alias("half"),
    )
    fields = {
        "l_orderkey": Field("int"), "l_linenumber": Field("int"), "flag": Field(domain=["A", "N"]), "zone": Field("int", zone=True, sentinels=[-1]),
        "quantity": Field("int", range=(3, 45), sentinels=[50.0]), "mode": Field(),
    }
    return model_tables.check_contract(d, fields, ["l_orderkey", "l_linenumber"])


@query(
    """WITH h AS (SELECT c_custkey AS id, c_custkey % 12 AS persons FROM customer), p AS (SELECT o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS id, o_orderkey AS person, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE 'F' END AS e,
    CASE WHEN o_orderkey % 6 = 0 THEN 'O' ELSE 'S' END AS o FROM orders),
t AS (SELECT l_orderkey + CASE WHEN l_orderkey % 70 = 0 THEN 10000000 ELSE 0 END AS person, l_linenumber + CASE WHEN l_orderkey % 40 = 0 AND l_linenumber > 2 THEN 1 ELSE 0 END + CASE WHEN l_orderkey % 90 = 0 THEN 1 ELSE 0 END AS trip,
    l_partkey % 100 AS st, CASE l_suppkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'R' ELSE 'W' END AS op, CASE WHEN l_partkey % 3 = 0 THEN 'H' ELSE 'S' END AS pu FROM lineitem),
n AS (SELECT person, min(trip) AS lo, max(trip) AS hi, count(*) AS n, count(DISTINCT trip) AS k FROM t GROUP BY 1), m AS (SELECT id, count(*) AS m FROM p GROUP BY 1)
SELECT 'ids_not_dense' AS invariant, CAST((SELECT min(id) <> 0 OR max(id) <> count(*) - 1 OR count(DISTINCT id) <> count(*) FROM h) AS BIGINT) AS broken
UNION ALL SELECT 'work_and_sector_differ', count(*) FILTER ((e = 'O') <> (o = 'O')) FROM p UNION ALL SELECT 'minutes_past_59', count(*) FILTER (st >= 60) FROM t UNION ALL SELECT 'demoted_origin', count(*) FILTER (op = 'R') FROM t
UNION ALL SELECT 'home_to_home', count(*) FILTER (op = 'H' AND pu = 'H') FROM t UNION ALL SELECT 'first_not_1', count(*) FILTER (lo <> 1) FROM n UNION ALL SELECT 'gaps', count(*) FILTER (hi - lo + 1 <> n OR k <> n) FROM n
UNION ALL SELECT 'smaller_than_members', count(*) FILTER (persons < m) FROM h JOIN m USING (id) UNION ALL SELECT 'people_without_household', count(*) FROM p WHERE id NOT IN (SELECT id FROM h)
UNION ALL SELECT 'trips_without_person', count(*) FROM t WHERE person NOT IN (SELECT person FROM p)"""
)
def check_invariants(spark, folder):
    o, li, key = read(spark, folder, "orders"), read(spark, folder, "lineitem"), F.col("l_orderkey")
    households = read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12).alias("persons"))
    people = o.select(
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1000000).otherwise(0)).alias("id"), F.col("o_orderkey").alias("person"),
        F.when(F.col("o_orderkey") % 3 == 0, "O").otherwise("F").alias("employment"), F.when(F.col("o_orderkey") % 6 == 0, "O").otherwise("S").alias("occupation"),
    )
    shift = F.when((key % 40 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0) + F.when(key % 90 == 0, 1).otherwise(0)
    trips = li.select(
        (key + F.when(key % 70 == 0, 10000000).otherwise(0)).alias("person"), (F.col("l_linenumber") + shift).alias("trip"), (F.col("l_partkey") % 100).alias("start_time"),
        F.when(F.col("l_suppkey") % 4 == 0, "H").when(F.col("l_suppkey") % 4 == 1, "R").otherwise("W").alias("origin_purpose"), F.when(F.col("l_partkey") % 3 == 0, "H").otherwise("S").alias("purpose"),
    )
    return model_tables.check_invariants(households, people, trips, "id", ["person"])


@query(
    """WITH d AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS a, CASE WHEN o_orderkey % 5 = 0 THEN -9.0 ELSE CAST(o_totalprice AS DOUBLE) END AS b, CAST(1 + o_custkey % 4 AS DOUBLE) AS w FROM orders)
SELECT 'a' AS "column", count(DISTINCT a) AS "distinct", min(a) AS low, median(a) AS median, max(a) AS high, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS nulls, 0 AS sentinel_rows, NULL::DOUBLE AS total FROM d
UNION ALL SELECT 'b', count(DISTINCT b), min(b) FILTER (b <> -9), median(b) FILTER (b <> -9), max(b) FILTER (b <> -9), 0, count(*) FILTER (b = -9), NULL FROM d
UNION ALL SELECT 'w', count(DISTINCT w), min(w), median(w), max(w), 0, 0, sum(w) FROM d"""
)
def profile_numbers(spark, folder):
    o = read(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("double")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, -9.0).otherwise(F.col("o_totalprice").cast("double")).alias("b"),
        (1 + F.col("o_custkey") % 4).cast("double").alias("w"),
    )
    return model_tables.profile_numbers(o, ["a", "b", "w"], {"b": -9.0}, "w")


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS code, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def profile_codes(spark, folder):
    return model_tables.profile_codes(read(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "WITH " + DIARY + """, c AS (SELECT day, hh, person, list(motive ORDER BY trip) AS sig, list(start ORDER BY trip) AS s FROM diary GROUP BY day, hh, person HAVING count(*) >= 2)
SELECT a.day, a.person, count(*) AS twins FROM c a JOIN c b ON a.day = b.day AND a.sig = b.sig AND a.hh <> b.hh WHERE list_max(list_transform(list_zip(a.s, b.s), lambda x: abs(x[1] - x[2]))) <= 120 GROUP BY 1, 2"""
)
def diary_twins(spark, folder):
    return joins.diary_twins(diary(spark, folder), ["day"], "hh", "person", "trip", "start", ["motive"], 120)


@query(
    """SELECT o_orderkey, o_orderstatus = 'F' AS late, o_orderkey % 9 = 0 AS odd, o_totalprice < 50000 AS small, false AS never FROM orders"""
)
def flags_to_columns(spark, folder):
    o, key = read(spark, folder, "orders"), F.col("o_orderkey")
    marks = F.concat_ws(";", F.when(F.col("o_orderstatus") == "F", "late"), F.when(key % 9 == 0, "odd"), F.when(F.col("o_totalprice") < 50000, "small"))
    return clean.flags_to_columns(o.select("o_orderkey", marks.alias("issues")), "issues", ["late", "odd", "small", "never"])


@query("SELECT l_orderkey, l_linenumber, o_custkey AS kept FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def drop_inherited(spark, folder):
    o = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    child = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")
    out = clean.drop_inherited(child, o, "l_orderkey", ["o_custkey", "o_orderstatus"])
    return out.join(o.select("l_orderkey", F.col("o_custkey").alias("kept")), "l_orderkey").select("l_orderkey", "l_linenumber", "kept")


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey % 70 END AS code FROM orders)
SELECT o_orderkey, CASE WHEN code IS NULL THEN 'missing' ELSE CASE code // 10 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'rest' END END AS level FROM o"""
)
def map_variable(spark, folder):
    from tripmill.operators import harmonize

    o = read(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_custkey") % 70).alias("code"))
    return harmonize.map_variable(o, "code", "level", {1: "one", 2: "two"}, divide=10, otherwise="rest", domain=range(7), missing="missing").drop("code")


@query(
    """WITH o AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'full' ELSE 'short' END AS arm, CASE WHEN o_custkey % 5 = 0 THEN 'status' ELSE '' END AS features, 1 + o_custkey % 5 AS w, 0.5 + (o_orderkey % 50) / 100.0 AS c FROM orders)
SELECT arm, features, count(*) AS rows, CAST(sum(w) AS BIGINT) AS total, round(sum(w) / (SELECT sum(w) FROM o), 6) AS share, round(min(c), 6)::DOUBLE AS low, round(sum(w * c) / sum(w), 6)::DOUBLE AS mean, round(max(c), 6)::DOUBLE AS high FROM o GROUP BY 1, 2"""
)
def imputation_usage_details(spark, folder):
    from tripmill.operators import imputation

    key = F.col("o_orderkey")
    o = read(spark, folder, "orders").select(
        F.when(key % 3 != 0, "full").otherwise("short").alias("arm"), F.when(F.col("o_custkey") % 5 == 0, "status").otherwise("").alias("features"), (1 + F.col("o_custkey") % 5).alias("w"),
        (0.5 + (key % 50) / 100.0).alias("c"),
    )
    return imputation.usage_details(o, "arm", "w", "c", "features").select("arm", "features", "rows", "total", *[F.round(c, 6).alias(c) for c in ("share", "low", "mean", "high")])


@query("SELECT o_orderkey AS id, o_orderpriority AS priority, round(o_totalprice::DOUBLE, 3) AS price FROM orders")
def write_tables_read_survey_csv(spark, folder):
    """A table written as CSV with fixed decimals, then read with its schema and renamed."""
    from tripmill.operators import contract
    from tripmill.sources.staging import shared_dir
    from tripmill.sources.tables import read_survey_csv

    o = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    place = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    contract.write_tables({"orders": o}, place, "csv", 3)
    names = {"o_orderkey": "id", "o_orderpriority": "priority", "o_totalprice": "price", "absent": "x"}
    return read_survey_csv(spark, f"{place}/orders", "o_orderkey long, o_orderpriority string, o_totalprice double", names)


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS before, o_orderpriority AS after FROM orders")
def read_decisions(spark, folder):
    """Decisions written as gzipped text and read: keys are numbers, empty text stays text."""
    from tripmill.operators import contract
    from tripmill.sources.staging import shared_dir

    key = F.col("o_orderkey")
    d = read(spark, folder, "orders").select("o_orderkey", "o_custkey", F.when(key % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("before"), F.col("o_orderpriority").alias("after"))
    place = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    d.write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(place)
    return contract.read_decisions(spark, place, ["o_orderkey", "o_custkey"])


@query()
def read_start_times(spark, folder):
    """Hour edits and moves to the arrival, twice."""
    from tripmill.operators import timing

    d = diary(spark, folder)
    back = F.when((F.col("event_id") % 13 == 0) & (F.col("start") >= 720), F.col("start") - 720).otherwise(F.col("start"))
    out = timing.read_start_times(d.withColumn("start", back), DAY, ["purchase"], BACK, ["purchase"], ["view"])
    return out.select(*DAY, "trip", "start", "edited", "slid")


@query()
def fit_arms(spark, folder):
    """A fitted model for each arm, and the rows each arm scores."""
    from tripmill.operators import imputation, model_chain, models

    o, key = read(spark, folder, "orders"), F.col("o_orderkey")
    o = o.select("o_orderkey", F.when(key % 3 != 0, F.col("o_orderpriority")).alias("pri"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice").cast("double") / 1000).alias("kilo"), (key % 2).alias("y"), F.lit(1.0).alias("w"))
    statuses, priorities = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    arms = {"full": ("logistic", {"pri": priorities, "status": statuses}, ["kilo"]), "short": ("forest", {"status": statuses}, ["kilo"])}
    fitted = models.fit_arms(o, arms, F.col("y"), "w", 2)
    placed = imputation.assign_arms(o, [("full", ["pri"]), ("short", ["status"])])
    parts = [model_chain.fitted_scorer(fitted[a], c, n)(placed.where(F.col("arm") == a)).select("o_orderkey", "arm", F.round(F.get("p", F.lit(1)), 6).alias("p")) for a, (_, c, n) in arms.items()]
    return parts[0].unionByName(parts[1])
