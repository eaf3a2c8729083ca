"""Registered queries on contracts, reports, targets and two-level draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import chains, clean, contract, harmonize, imputation, joins, reports, targets, zones
from tripmill.operators.contract import Rule, Variable
from tripmill.sources.tables import read

from .queries import BACK, DAY, diary, query, r
from .records import UNIFORM

# -- contracts --------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) - INTERVAL (o_orderkey % 20) YEAR END AS day FROM orders)
SELECT o_orderkey, CAST(day AS DATE) AS day, CAST(month(day) AS INTEGER) AS month FROM d"""
)
def parse_survey_date(spark, folder):
    o = read(spark, folder, "orders")
    text = F.date_format(F.add_months("o_orderdate", (-12 * (F.col("o_orderkey") % 20)).cast("int")), "d-MMM-yy")
    day = contract.parse_survey_date(F.when(F.col("o_orderkey") % 17 != 0, text).otherwise("no date"))
    return o.select("o_orderkey", day.alias("day"), F.month(day).alias("month"))


RULES = {
    "l_orderkey": Rule("bigint", nullable=False), "l_linenumber": Rule("int", low=1, high=6), "l_quantity": Rule("double", low=2),
    "l_returnflag": Rule("string", levels=["A", "N"]), "l_linestatus": Rule("string", lengths=[1]), "mode": Rule("int", nullable=False),
}


@query(
    """WITH d AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 'x' ELSE '3' END AS mode FROM lineitem)
SELECT * FROM (SELECT 'l_linenumber' AS "column", 'range' AS rule, count(*) FILTER (l_linenumber < 1 OR l_linenumber > 6) AS "rows" FROM d
  UNION ALL SELECT 'l_quantity', 'range', count(*) FILTER (l_quantity < 2) FROM d UNION ALL SELECT 'l_returnflag', 'level', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM d
  UNION ALL SELECT 'mode', 'type', count(*) FILTER (mode = 'x') FROM d UNION ALL SELECT 'mode', 'null', count(*) FILTER (mode IS NULL) FROM d
  UNION ALL SELECT 'l_orderkey+l_linenumber', 'key', count(*) FROM (SELECT 1 FROM d GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) WHERE "rows" > 0"""
)
def schema_violations(spark, folder):
    mode = F.when(F.col("l_partkey") % 9 == 0, None).when(F.col("l_partkey") % 7 == 0, "x").otherwise("3")
    return contract.schema_violations(read(spark, folder, "lineitem").withColumn("mode", mode), RULES, ["l_orderkey", "l_linenumber"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS SMALLINT) AS n_regionkey FROM nation")
def conform_schema(spark, folder):
    text = read(spark, folder, "nation").select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")])
    rules = {"n_nationkey": Rule("bigint", False, low=0), "n_name": Rule("string", False), "n_regionkey": Rule("smallint", False, levels=[0, 1, 2, 3, 4])}
    return contract.conform_schema(text, rules, ["n_nationkey"])


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'q1' WHEN 1 THEN 'q2' ELSE 'q3' END AS period, (1 + o_custkey % 7) / 3 AS w,
  concat_ws('-', o_custkey, o_orderstatus) AS hh FROM orders"""
)
def pool_waves(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (1 + F.col("o_custkey") % 7).cast("double").alias("w"))
    waves = {f"q{k + 1}": o.where(F.col("o_orderkey") % 3 == k) for k in range(3)}
    return contract.pool_waves(waves, "w", ["o_custkey", "o_orderstatus"]).select("o_orderkey", "period", "w", "hh")


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_lookup(spark, folder):
    s = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return contract.strict_lookup(s, "s_nationkey", read(spark, folder, "nation"), "n_nationkey", "n_name")


SPEC = [
    Variable("price_class", lambda: harmonize.bins_variable(F.col("o_totalprice"), [50_000, 150_000], ["low", "middle", "high"]), ["o_totalprice"]),
    Variable("unused", lambda: F.lit(1), ["o_custkey"]),
    Variable("open", lambda: (F.col("o_orderstatus") == "O").cast("int"), ["o_orderstatus"]),
    Variable("kind", lambda: harmonize.rules_variable([(F.col("open") == 1, "open"), (F.col("price_class") == "high", "dear")], "plain"), ["open", "price_class"]),
]


@query(
    """SELECT o_orderkey, price_class, open, CASE WHEN price_class = 'high' THEN 'dear' WHEN open = 1 THEN 'open' ELSE 'plain' END AS kind
FROM (SELECT *, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'middle' ELSE 'high' END AS price_class, (o_orderstatus = 'O')::INT AS open FROM orders)"""
)
def apply_variables(spark, folder):
    o = read(spark, folder, "orders")
    return contract.apply_variables(o, SPEC, "kind").select("o_orderkey", "price_class", "open", "kind")


@query(
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'bus' END AS m1, CASE WHEN o_orderkey % 3 = 0 THEN 'car' END AS m2, CASE WHEN o_orderkey % 4 = 0 THEN 'walk' END AS m3,
  o_custkey % 30 AS t1, o_custkey % 20 AS t2, o_custkey % 10 AS t3, 1 + o_orderkey % 3 AS declared FROM orders),
l AS (SELECT *, (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT AS used, CASE WHEN m3 IS NOT NULL THEN 3 WHEN m2 IS NOT NULL THEN 2 WHEN m1 IS NOT NULL THEN 1 ELSE 0 END AS last,
  greatest(CASE WHEN m1 IS NOT NULL THEN t1 END, CASE WHEN m2 IS NOT NULL THEN t2 END, CASE WHEN m3 IS NOT NULL THEN t3 END) AS longest FROM s)
SELECT o_orderkey, CAST(used AS BIGINT) AS used, last > used AS gap, used = declared AS count_ok, m1 IS NOT NULL AS main_used, coalesce(m1 IS NOT NULL AND t1 = longest, false) AS main_longest,
  CAST(coalesce((m1 IS NOT NULL AND t1 = longest)::INT, 0) + coalesce((m2 IS NOT NULL AND t2 = longest)::INT, 0) + coalesce((m3 IS NOT NULL AND t3 = longest)::INT, 0) AS BIGINT) AS ties FROM l"""
)
def leg_slot_audit(spark, folder):
    key = F.col("o_orderkey")
    slots = {"m1": F.when(key % 5 != 0, "bus"), "m2": F.when(key % 3 == 0, "car"), "m3": F.when(key % 4 == 0, "walk"), "declared": 1 + key % 3, "main": F.lit("bus")}
    o = read(spark, folder, "orders").withColumns(slots | {f"t{k}": F.col("o_custkey") % n for k, n in ((1, 30), (2, 20), (3, 10))})
    out = contract.leg_slot_audit(o, ["m1", "m2", "m3"], ["t1", "t2", "t3"], "declared", "main")
    return out.select("o_orderkey", "used", "gap", "count_ok", "main_used", "main_longest", "ties")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 2)::DOUBLE ELSE 1 - (o_orderkey % 7) / 7 END AS answer FROM orders")
def imputed_attribute(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 2).alias("answer"))
    shares = read(spark, folder, "orders").select("o_orderkey", ((F.col("o_orderkey") % 7) / 7).alias("p")).where("o_orderkey % 4 = 0")
    return contract.imputed_attribute(o, ["o_orderkey"], "answer", shares, "p", complement=True)


@query("SELECT l_orderkey, CAST(least(sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END), 1) AS BIGINT) AS legs FROM lineitem GROUP BY 1")
def leg_count_attribute(spark, folder):
    return contract.leg_count_attribute(read(spark, folder, "lineitem"), ["l_orderkey"], "l_returnflag", {"A": 1, "R": 2}, once=True)


@query(
    """SELECT o_orderkey, CAST(z AS BIGINT) AS zone_id, CAST(z * 1000 + m AS BIGINT) AS cell FROM (SELECT o_orderkey,
  list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS z, list_position(['F', 'O', 'P'], o_orderstatus) AS m FROM orders)"""
)
def zone_ids(spark, folder):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return contract.zone_ids(read(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", levels, ["F", "O", "P"]).select("o_orderkey", "zone_id", "cell")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'nation' ELSE 'region' END AS grain, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE r_name END AS area
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def area_units_crosswalk(spark, folder):
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    c = read(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    units = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("n_nationkey")).alias("town"), F.col("n_regionkey").alias("locality"))
    towns = nation.select(F.col("n_nationkey").alias("town"), F.lit("nation").alias("grain"), F.col("n_name").alias("area"))
    places = region.select(F.col("r_regionkey").alias("locality"), F.lit("region").alias("grain"), F.col("r_name").alias("area"))
    return contract.area_units_crosswalk(units, towns, places, "c_custkey", "town", "locality").select("c_custkey", "grain", "area")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus WHEN o_custkey % 2 = 0 THEN 'x' || (o_custkey + 2) % 5 END AS status FROM orders"""
)
def attach_draw(spark, folder):
    o = read(spark, folder, "orders")
    d = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("status"))
    drawn = F.concat(F.lit("x"), ((F.col("o_custkey") + F.col("draw")) % 5).cast("string"))
    draws = o.select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("draw")).withColumn("status", drawn).drop("o_custkey")
    return contract.attach_draw(d, ["o_orderkey"], draws, 2, "status", F.col("o_custkey") % 2 == 0).select("o_orderkey", "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(nullif(nullif(l_returnflag, 'N'), 'R'), '') AS flag FROM lineitem")
def null_tokens(spark, folder):
    d = read(spark, folder, "lineitem").withColumn("flag", F.col("l_returnflag"))
    return clean.null_tokens(d, ["N", "R", ""]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE c_mktsegment END AS segment FROM customer"""
)
def prepare_features(spark, folder):
    c = read(spark, folder, "customer")
    text = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a")
    segment = F.when(F.col("c_custkey") % 8 == 0, "  ").when(F.col("c_custkey") % 4 != 0, F.concat(F.lit(" "), "c_mktsegment"))
    return harmonize.prepare_features(c.select("c_custkey", text.alias("balance"), segment.alias("segment")), ["balance"], ["segment"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 + o_custkey % 7 AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def attach_weight(spark, folder):
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    weights = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 7).alias("w"))
    return joins.attach_weight(lines, weights, "l_orderkey", "w")


# -- reports ----------------------------------------------------------------------------

TWINS = """, c AS (SELECT day, hh, person, list(motive ORDER BY trip) AS sig, list(start ORDER BY trip) AS s FROM diary GROUP BY day, hh, person HAVING count(*) >= 2),
p AS (SELECT a.day, a.person FROM c a JOIN c b ON a.day = b.day AND a.sig = b.sig AND a.hh <> b.hh WHERE list_max(list_transform(list_zip(a.s, b.s), lambda x: abs(x[1] - x[2]))) <= 240)"""


@query(
    TWINS + " SELECT DISTINCT d.day, d.person, EXISTS (SELECT 1 FROM p WHERE p.day = d.day AND p.person = d.person) AS repeated_diary FROM diary d",
    diary=True,
)
def flag_repeated_diaries(spark, folder):
    d = diary(spark, folder)
    twins = joins.nearest_twins(joins.diaries_of(d, ["day"], "hh", "person", "trip", "start", ["motive"]), ["day"], [], 240)
    return reports.flag_repeated_diaries(d.select("day", "person").distinct(), twins, ["day", "person"], [("day", "p")])


@query(
    """SELECT c_nationkey, round(ln(1 + count(*)), 6) AS log_units, round(sum(CASE WHEN c_custkey % 3 = 0 THEN w ELSE 0 END) / sum(w), 6) AS size_0, round(sum(CASE WHEN c_custkey % 3 = 1 THEN w ELSE 0 END) / sum(w), 6) AS size_1,
  round(sum(CASE WHEN substr(c_mktsegment, 1, 2) = 'BU' THEN w ELSE 0 END) / sum(w), 6) AS "sector_BU", round(sum(CASE WHEN substr(c_mktsegment, 1, 2) = 'HO' THEN w ELSE 0 END) / sum(w), 6) AS "sector_HO"
FROM (SELECT *, 1 + c_custkey % 5 AS w FROM customer) GROUP BY 1"""
)
def weighted_mix(spark, folder):
    c = read(spark, folder, "customer").withColumns({"size": F.col("c_custkey") % 3, "w": 1 + F.col("c_custkey") % 5})
    out = reports.weighted_mix(c, "c_nationkey", "size", [0, 1], "c_mktsegment", ["BU", "HO"], "w")
    return out.select("c_nationkey", *[r(F.col(n), n) for n in out.columns[1:]])


@query(
    """WITH j AS (SELECT o_orderkey, o_orderstatus, l_quantity AS cw, 1 + o_custkey % 7 AS pw FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_orderstatus, count(*) AS parents, CAST(sum(v) AS BIGINT) AS varying FROM (SELECT o_orderstatus, o_orderkey, (count(DISTINCT cw) > 1)::INT AS v FROM j GROUP BY ALL) GROUP BY 1)
SELECT o_orderstatus, parents, varying, round(median(cw / pw), 6) AS ratio, sum(cw)::DOUBLE AS child_sum, sum(pw)::DOUBLE AS parent_sum FROM j JOIN p USING (o_orderstatus) GROUP BY ALL"""
)
def weight_consistency(spark, folder):
    o = read(spark, folder, "orders").withColumn("pw", 1 + F.col("o_custkey") % 7)
    lines = read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return reports.weight_consistency(lines, o, "o_orderkey", "l_quantity", "pw", "o_orderstatus").withColumn("ratio", F.round("ratio", 6))


@query(
    """WITH l AS (SELECT 'o_orderstatus' AS feature, o_orderstatus AS level, o_orderkey % 5 = 0 AS u, 1 + o_custkey % 7 AS w FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderkey % 5 = 0, 1 + o_custkey % 7 FROM orders),
s AS (SELECT feature, level, sum(w) FILTER (NOT u) AS k, sum(w) FILTER (u) AS m FROM l GROUP BY 1, 2),
t AS (SELECT feature, level, coalesce(k, 0) / sum(k) OVER (PARTITION BY feature) AS k, coalesce(m, 0) / sum(m) OVER (PARTITION BY feature) AS m FROM s)
SELECT feature, level, round(k, 6) AS known, round(m, 6) AS unknown, round(100 * (m - k), 6) AS difference FROM t"""
)
def compare_profiles(spark, folder):
    o = read(spark, folder, "orders").withColumn("w", 1 + F.col("o_custkey") % 7)
    out = reports.compare_profiles(o, ["o_orderstatus", "o_orderpriority"], F.col("o_orderkey") % 5 == 0, "w")
    return out.select("feature", "level", *[r(F.col(c), c) for c in ("known", "unknown", "difference")])


SCORED = """SELECT o_orderkey, o_orderpriority, o_custkey, (o_orderkey * 37 % 1000 + 0.5) / 1000 AS p, (o_orderkey % 3 = 0)::INT AS y, 1 + o_custkey % 7 AS w FROM orders"""


def _scored(spark, folder):
    key = F.col("o_orderkey")
    return read(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", "o_custkey", ((key * 37 % 1000 + 0.5) / 1000).alias("p"), (key % 3 == 0).cast("int").alias("y"),
        (1 + F.col("o_custkey") % 7).alias("w"),
    )


@query(
    f"""WITH s AS (SELECT least(floor(p * 10), 9) AS c, sum(w) AS w, sum(w * p) AS wp, sum(w * y) AS wy FROM ({SCORED}) GROUP BY 1)
SELECT round(sum(abs(wp - wy)) / sum(w), 6) AS ece, round(100 * (sum(wp) - sum(wy)) / sum(w), 6) AS gap_pp FROM s"""
)
def calibration_metrics(spark, folder):
    return reports.calibration_metrics(_scored(spark, folder), "p", "y", "w").select(r(F.col("ece"), "ece"), r(F.col("gap_pp"), "gap_pp"))


@query(
    """WITH a AS (SELECT o_custkey % 11 AS area, o_orderpriority AS level, 1 + o_custkey % 7 AS w FROM orders WHERE o_custkey % 11 < 8), b AS (SELECT l_suppkey % 11 AS area, CASE l_linenumber % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'new' END AS level, l_quantity AS n FROM lineitem WHERE l_suppkey % 11 > 2),
x AS (SELECT level, sum(w) AS v FROM a WHERE area > 2 GROUP BY 1), z AS (SELECT level, sum(n) AS v FROM b WHERE area < 8 GROUP BY 1)
SELECT level, round(coalesce(x.v, 0) / (SELECT sum(v) FROM x), 6) AS share, round(coalesce(z.v, 0) / (SELECT sum(v) FROM z), 6) AS reference_share FROM x FULL JOIN z USING (level)"""
)
def compare_to_reference(spark, folder):
    own = read(spark, folder, "orders").select((F.col("o_custkey") % 11).alias("area"), F.col("o_orderpriority").alias("level"), (1 + F.col("o_custkey") % 7).alias("w")).where("area < 8")
    level = F.when(F.col("l_linenumber") % 3 == 0, "1-URGENT").when(F.col("l_linenumber") % 3 == 1, "5-LOW").otherwise("new")
    other = read(spark, folder, "lineitem").select((F.col("l_suppkey") % 11).alias("area"), level.alias("level"), F.col("l_quantity").alias("n")).where("area > 2")
    out = reports.compare_to_reference(own, "area", "level", "w", other, "n")
    return out.select("level", r(F.col("share"), "share"), r(F.col("reference_share"), "reference_share"))


RATES = f"""WITH b AS (SELECT o_orderpriority, avg(y) AS benchmark, count(*) AS s FROM ({SCORED}) GROUP BY 1), g AS (SELECT o_orderpriority, sum(w * p) / sum(w) AS expected, sum(w) AS w FROM ({SCORED}) GROUP BY 1),
r AS (SELECT o_orderpriority, expected, benchmark, w / sum(w) OVER () AS share, s / sum(s) OVER () AS benchmark_share FROM g JOIN b USING (o_orderpriority)),
f AS (SELECT *, share * (expected - benchmark) AS model, (share - benchmark_share) * benchmark AS composition FROM r)"""


def _rates(spark, folder):
    s = _scored(spark, folder)
    benchmark = s.groupBy("o_orderpriority").agg(F.avg("y").alias("rate"), F.count("*").alias("n"))
    return reports.benchmark_rates(s, "o_orderpriority", "p", "w", benchmark, "rate", "n")


@query(
    RATES + """SELECT o_orderpriority, round(expected, 6) AS expected, round(benchmark, 6) AS benchmark, round(share, 6) AS share, round(benchmark_share, 6) AS benchmark_share,
  round(model, 6) AS model, round(composition, 6) AS composition FROM f"""
)
def benchmark_rates(spark, folder):
    names = ("expected", "benchmark", "share", "benchmark_share", "model", "composition")
    return _rates(spark, folder).select("o_orderpriority", *[r(F.col(c), c) for c in names])


@query(RATES + "SELECT round(sum(share * expected), 6) AS expected, round(sum(benchmark_share * benchmark), 6) AS benchmark, round(sum(model), 6) AS model, round(sum(composition), 6) AS composition FROM f")
def chain_headline(spark, folder):
    out = reports.chain_headline(_rates(spark, folder))
    return out.select(*[r(F.col(c), c) for c in out.columns])


@query(
    """SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 3 THEN c_nationkey END AS found, CASE WHEN c_custkey % 13 <> 4 THEN CASE WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END END AS wanted,
  CASE WHEN c_custkey % 10 = 3 THEN 'missing' WHEN c_custkey % 13 = 4 THEN 'unexpected' WHEN c_custkey % 7 = 0 THEN 'differs' END AS status FROM customer WHERE c_custkey % 10 <> 3 OR c_custkey % 13 <> 4) WHERE status IS NOT NULL"""
)
def check_assignment(spark, folder):
    c = read(spark, folder, "customer")
    other = F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    wanted = c.where("c_custkey % 13 <> 4").select("c_custkey", other.alias("zone"))
    return reports.check_assignment(c.where("c_custkey % 10 <> 3").select("c_custkey", F.col("c_nationkey").alias("zone")), wanted, "c_custkey", "zone")


@query(
    """WITH i AS (SELECT p_brand || CASE WHEN p_size = 7 THEN 'x' ELSE '' END AS id, count(*) AS n FROM part GROUP BY 1), w AS (SELECT 'Brand#' || r AS id FROM range(1, 12) v(r))
SELECT 'format' AS "check", count(*) FILTER (NOT regexp_full_match(id, 'Brand#[0-9]+')) AS "rows" FROM i UNION ALL SELECT 'repeated', count(*) FILTER (n > 1) FROM i
UNION ALL SELECT 'missing', count(*) FROM w WHERE id NOT IN (SELECT id FROM i)"""
)
def check_zone_ids(spark, folder):
    p = read(spark, folder, "part").select(F.concat("p_brand", F.when(F.col("p_size") == 7, "x").otherwise("")).alias("id"))
    wanted = spark.range(1, 12).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("id"))
    return reports.check_zone_ids(p, "id", "^Brand#[0-9]+$", wanted)


@query(
    """SELECT c_nationkey, count(*) AS units, count(DISTINCT c_mktsegment) AS localities, round(sum(c_acctbal), 2) AS population, coalesce(max(s.n), 0) AS sampled
FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) s ON s_nationkey = c_nationkey GROUP BY 1"""
)
def zone_summary(spark, folder):
    sample = read(spark, folder, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("c_nationkey"))
    out = reports.zone_summary(read(spark, folder, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", sample)
    return out.withColumn("population", F.round("population", 2))


@query("SELECT p_brand, count(DISTINCT p_type) AS zones FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def split_code_check(spark, folder):
    return reports.split_codes(read(spark, folder, "part"), "p_brand", "p_type")


@query(
    """SELECT c_custkey, round(CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE greatest(0.5, least(2, (1000 - c_custkey % 300) / (c_custkey % 50 * 20))) END, 6) AS scale FROM customer"""
)
def person_scale(spark, folder):
    c = read(spark, folder, "customer")
    people, collective, stated = F.lit(1000), F.col("c_custkey") % 300, F.col("c_custkey") % 50 * 20
    return c.select("c_custkey", r(zones.scale(people - collective, stated, 0.5, 2.0), "scale"))


CODED = """, w AS (SELECT *, concat_ws(';', CASE WHEN start < lag(start + minutes) OVER k THEN 'overlap' END, CASE WHEN dest = home AND motive <> 'signup' THEN 'home' END) AS issues,
  CASE WHEN trip > 1 AND dest = home AND origin <> home AND motive <> 'signup' THEN 'signup' ELSE motive END AS fixed FROM diary WINDOW k AS (PARTITION BY person, day ORDER BY trip))"""


def _coded(spark, folder):
    d = diary(spark, folder)
    overlap = F.when(F.col("start") < F.lag(F.col("start") + F.col("minutes")).over(chains.over(DAY)), "overlap")
    code = F.when((F.col("dest") == F.col("home")) & (F.col("motive") != BACK), "home")
    return d.withColumn("issues", F.concat_ws(";", overlap, code))


@query(
    CODED + """, c AS (SELECT * FROM w WHERE event_id % 9 <> 0)
SELECT event_id, field, before, CASE WHEN event_id % 9 <> 0 THEN after END AS after, CASE WHEN event_id % 9 <> 0 THEN issues END AS issues, event_id % 9 = 0 AS dropped
FROM (SELECT event_id, 'motive' AS field, motive AS before, fixed AS after, issues FROM w UNION ALL SELECT event_id, 'dest', dest::VARCHAR, dest::VARCHAR, issues FROM w)""",
    diary=True,
)
def chain_rows(spark, folder):
    d = _coded(spark, folder)
    cleaned = chains.arrivals_home(d, DAY, BACK).where("event_id % 9 <> 0")
    return reports.chain_rows(d, cleaned, ["event_id"], ["motive", "dest"], ["issues"])


@query(CODED + "SELECT person, day, array_to_string(list_sort(list(DISTINCT c)), ';') AS codes FROM (SELECT person, day, unnest(string_split(issues, ';')) AS c FROM w) WHERE c <> '' GROUP BY 1, 2", diary=True)
def pending_persons(spark, folder):
    return reports.pending_persons(_coded(spark, folder), ["person", "day"], "issues")


@query(
    CODED + """, s AS (SELECT person, day, count(*) FILTER (motive <> fixed) AS n FROM w GROUP BY 1, 2)
SELECT person, day, CASE WHEN person % 20 = 1 THEN 'added' WHEN person % 20 = 2 THEN 'removed' ELSE 'changed' END AS status FROM s WHERE n > 0 OR person % 20 IN (1, 2)""",
    diary=True,
)
def snapshot_changes(spark, folder):
    d = diary(spark, folder)
    after = chains.arrivals_home(d, DAY, BACK).where("person % 20 <> 2")
    return reports.snapshot_changes(d.where("person % 20 <> 1"), after, DAY, ["trip", "motive", "dest", "start"])


# -- targets ----------------------------------------------------------------------------

AREAS = """SELECT o_orderkey AS area, o_custkey % 9 AS zone, o_custkey % 40 AS locality, CASE WHEN o_orderkey % 19 <> 0 THEN 10 + o_custkey % 70 END AS men, 5 + o_orderkey % 90 AS women, 1 + (o_orderkey % 4) / 10 AS correction,
  1 + (o_custkey % 3) / 20 AS growth, 100.0 * (1 + o_custkey % 9) AS zone_total, 20 + o_orderkey % 30 AS dwellings FROM orders"""
TARGETS = (
    f"""WITH a AS ({AREAS}), t AS (SELECT *, coalesce(men, 0) * correction AS men0, women::DOUBLE AS women0 FROM a), g AS (SELECT *, men0 * growth AS men_t, women0 * growth AS women_t FROM t),
p AS (SELECT *, (men_t + women_t) AS people, dwellings * CASE WHEN men0 + women0 <> 0 THEN (men_t + women_t) / (men0 + women0) ELSE 1 END AS homes0 FROM g),
d AS (SELECT *, homes0 * zone_total / sum(homes0) OVER (PARTITION BY zone) AS homes1 FROM p), f AS (SELECT *, least(homes1, 0.8 * people) AS homes FROM d)"""
)
TARGET_SPEC = [
    targets.Target("men_t", "men", correct="correction", grow="growth"), targets.Target("women_t", "women", grow="growth"),
    targets.Target("people", sum_of=["men_t", "women_t"]),
    targets.Target("homes", "dwellings", grow_with=["men_t", "women_t"], grow_within=("zone", "zone_total"), cap=("people", 0.8)),
]


def _areas(spark, folder):
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    areas = read(spark, folder, "orders").select(
        key.alias("area"), (c % 9).alias("zone"), (c % 40).alias("locality"), F.when(key % 19 != 0, 10 + c % 70).alias("men"), (5 + key % 90).alias("women"),
        (1 + (key % 4) / 10).alias("correction"), (1 + (c % 3) / 20).alias("growth"), (100.0 * (1 + c % 9)).alias("zone_total"), (20 + key % 30).alias("dwellings"),
    )
    return targets.row_targets(areas, TARGET_SPEC)


@query(TARGETS + "SELECT area, round(men_t, 6) AS men_t, round(women_t, 6) AS women_t, round(people, 6) AS people, round(homes, 6) AS homes FROM f")
def row_targets(spark, folder):
    return _areas(spark, folder).select("area", *[r(F.col(c), c) for c in ("men_t", "women_t", "people", "homes")])


@query(
    TARGETS + """, s AS (SELECT l_suppkey % 30 AS area, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT area % 50 AS area, zone, locality, people, homes FROM f)
SELECT area, min(zone) AS zone, count(DISTINCT locality) AS localities, round(sum(people), 4) AS people, round(sum(homes), 4) AS homes, coalesce(max(n), 0) AS sampled FROM b LEFT JOIN s USING (area) GROUP BY 1"""
)
def area_targets(spark, folder):
    sampled = read(spark, folder, "lineitem").select((F.col("l_suppkey") % 30).alias("area"))
    areas = _areas(spark, folder).withColumn("area", F.col("area") % 50)
    out = targets.area_targets(areas, sampled, "area", "zone", "locality", ["people", "homes"])
    return out.withColumns({"people": F.round("people", 4), "homes": F.round("homes", 4)})


@query(TARGETS + """SELECT zone, k AS "constraint", round(CASE k WHEN 'people' THEN sum(people) ELSE sum(homes) END, 4) AS target FROM f, (VALUES ('people'), ('homes')) v(k) GROUP BY zone, k""")
def build_constraints(spark, folder):
    return targets.build_constraints(_areas(spark, folder), "zone", ["people", "homes"]).withColumn("target", F.round("target", 4))


@query(
    """WITH rec AS (SELECT DISTINCT o_custkey % 11 AS zone FROM orders WHERE o_custkey % 11 <> 3), has AS (SELECT DISTINCT o_custkey % 11 AS zone FROM orders WHERE o_custkey % 11 <> 3 AND o_orderstatus = 'P' AND o_custkey % 11 <> 5),
c AS (SELECT zone, 100 + zone AS whole, CASE WHEN zone = 2 THEN -1 ELSE 60 + zone END AS p, 40 AS q FROM range(1, 13) v(zone))
SELECT 'repeated' AS "check", 0::BIGINT AS "rows" UNION ALL SELECT 'null_or_negative', 1 UNION ALL SELECT 'zone_without_constraints', count(*) FROM rec WHERE zone NOT IN (SELECT zone FROM c)
UNION ALL SELECT 'zone_without_records', count(*) FROM c WHERE zone NOT IN (SELECT zone FROM rec)
UNION ALL SELECT 'unsupported', (SELECT count(*) FROM c WHERE p > 0 AND zone NOT IN (SELECT zone FROM has)) + 2 * (SELECT count(*) FROM c WHERE zone NOT IN (SELECT zone FROM rec))
UNION ALL SELECT 'parts_differ:whole', count(*) FILTER (abs(p + q - whole) > 1e-6) FROM c UNION ALL SELECT 'parts_exceed:whole', count(*) FILTER (p - whole > 1e-6) FROM c"""
)
def check_constraint_set(spark, folder):
    zone = F.col("o_custkey") % 11
    rec = read(spark, folder, "orders").where("o_custkey % 11 <> 3").select(zone.alias("zone"), F.lit(1).alias("one"), ((F.col("o_orderstatus") == "P") & (zone != 5)).cast("int").alias("p"))
    wide = spark.range(1, 13).select(F.col("id").alias("zone"), (100.0 + F.col("id")).alias("whole"), F.when(F.col("id") == 2, -1).otherwise(60 + F.col("id")).alias("p"), F.lit(40).alias("q"))
    constraints = targets.build_constraints(wide, "zone", ["whole", "p", "q"])
    return targets.check_constraint_set(constraints, rec, "zone", {"whole": "one", "p": "p", "q": "one"}, {"whole": ["p", "q"]}, {"whole": ["p"]})


# -- imputation -------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS status, o_orderstatus = 'P' AS unknown, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def build_task_frame(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    c = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return imputation.build_task_frame(o, [(c, ["o_custkey"])], "status", {"F": "done", "O": "open"}).drop("o_custkey")


@query("SELECT o_orderkey, round((o_orderkey % 5) / 10 * 3 + (1 - (o_orderkey % 5) / 10) * 7.5, 6) AS expected FROM orders")
def chain_expected(spark, folder):
    p = (F.col("o_orderkey") % 5) / 10
    o = read(spark, folder, "orders").select("o_orderkey", p.alias("p"), (1 - p).alias("q"))
    return imputation.chain_expected(o, "o_orderkey", {"a": "p", "b": "q"}, {"a": 3, "b": 7.5}).withColumn("expected", F.round("expected", 6))


@query(
    """WITH n AS (SELECT l_orderkey, unnest(string_split(l_returnflag || '+' || l_linestatus, '+')) AS n FROM lineitem)
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT n)), '+') AS names FROM n GROUP BY 1"""
)
def join_names_over_scenarios(spark, folder):
    d = read(spark, folder, "lineitem").select("l_orderkey", F.concat_ws("+", "l_returnflag", "l_linestatus").alias("names"))
    return imputation.join_names_over_scenarios(d, "l_orderkey", "names")


@query(
    f"""WITH p AS (SELECT o_orderkey, o_custkey, draw, {UNIFORM.format("o_orderkey, draw, 0, 23")} < 0.2 + (o_orderkey % 5) / 10 AS works FROM orders, range(1, 5) v(draw)),
m AS (SELECT o_custkey AS c_custkey, draw, sum(works::INT) AS n FROM p GROUP BY 1, 2),
h AS (SELECT c_custkey, draw, CAST(least(coalesce(n, 0), 2) AS BIGINT) AS members, {UNIFORM.format("c_custkey, draw, 1, 23")} AS u FROM customer CROSS JOIN range(1, 5) v(draw) LEFT JOIN m USING (c_custkey, draw))
SELECT c_custkey, draw, members, CASE WHEN u < CASE members WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.7 END THEN 'net' ELSE 'none' END AS net FROM h"""
)
def pipeline_two_levels(spark, folder):
    p = 0.2 + (F.col("o_orderkey") % 5) / 10
    persons = read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), p.alias("w"), (1 - p).alias("x"))
    shares = {f"p{n}": F.lit(s) for n, s in enumerate((0.2, 0.5, 0.7))} | {f"q{n}": F.lit(1 - s) for n, s in enumerate((0.2, 0.5, 0.7))}
    households = read(spark, folder, "customer").select("c_custkey").withColumns(shares)
    job = ("job", ["works", "rests"], {None: ["w", "x"]})
    net = ("net", ["net", "none"], {n: [f"p{n}", f"q{n}"] for n in range(3)})
    return imputation.pipeline_two_levels(persons, households, "o_orderkey", "c_custkey", 4, 23, job, "works", net, 2)
