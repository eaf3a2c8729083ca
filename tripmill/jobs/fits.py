"""Registered queries on model fits, calibration, nearest zones and their corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import imputation, models, zones
from tripmill.sources.tables import read

from .queries import query, r

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _orders(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    p = (F.col("o_orderkey") * 37 % 1000 + 0.5) / 1000
    y = (F.crc32(F.col("o_orderkey").cast("string").cast("binary")) % 1000 < 900 * p).cast("int")
    return o.withColumns({"p": p, "y": y, "w": (1 + F.col("o_custkey") % 7).cast("double"), "kilo": F.col("o_totalprice").cast("double") / 1000})


@query(
    "SELECT o_orderpriority, round(w / sum(w) OVER (), 6) AS share FROM (SELECT o_orderpriority, sum(1 + o_custkey % 7)::DOUBLE AS w FROM orders GROUP BY 1)"
)
def level_shares(spark, folder):
    return models.level_shares(_orders(spark, folder), "o_orderpriority", "w").withColumn("share", F.round("share", 6))


@query(
    """WITH l AS (SELECT status, w / sum(w) OVER () AS share FROM (SELECT o_orderstatus AS status, sum(1 + o_custkey % 7)::DOUBLE AS w FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)),
s AS (SELECT sum(share * CASE status WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.5 ELSE 0.9 END) AS m FROM l)
SELECT o_orderkey, round(CASE WHEN o_orderkey % 11 = 0 THEN m ELSE CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.5 ELSE 0.9 END END, 6) AS p,
  CASE WHEN o_orderkey % 11 = 0 THEN 'status' ELSE '' END AS features FROM orders, s"""
)
def marginalize_unsupported(spark, folder):
    o = _orders(spark, folder).withColumn("status", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).otherwise("new"))
    shares = models.level_shares(_orders(spark, folder).where("o_custkey % 3 <> 0").withColumnRenamed("o_orderstatus", "status"), "status", "w")
    p = F.when(F.col("status") == "F", 0.2).when(F.col("status") == "O", 0.5).otherwise(0.9)
    done = models.marginalize_unsupported(o, "o_orderkey", {"status": shares}, lambda _: p)
    return done.withColumn("p", F.round("p", 6))


@query(
    """WITH o AS (SELECT o_orderkey, (o_orderkey * 37 % 1000 + 0.5) / 1000 AS p, (1 + o_custkey % 7)::DOUBLE AS w FROM orders),
c AS (SELECT p AS q, sum(w) AS w, sum(w * p) AS wp FROM o GROUP BY 1),
n AS (SELECT q, (0.7 * sum(w) OVER () - (sum(w) OVER (ORDER BY q DESC) - w)) / (sum(wp) OVER () - sum(wp) OVER (ORDER BY q DESC) + wp) AS f FROM c),
k AS (SELECT f FROM n WHERE f * q <= 1 ORDER BY q DESC LIMIT 1)
SELECT o_orderkey, round(least(1.0, p * f), 6) AS adjusted FROM o, k"""
)
def adjust_share(spark, folder):
    return models.adjust_share(_orders(spark, folder), "p", "w", 0.7).select("o_orderkey", r(F.col("adjusted"), "adjusted"))


@query()
def score_task(spark, folder):
    o = models.encode(_orders(spark, folder), {"o_orderpriority": PRIORITIES}, ["p", "kilo"])
    answer = F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("y") == 1, "yes").otherwise("no"))
    o = o.withColumn("answer", answer)
    model = models.fit(o, F.when(F.col("answer").isNotNull(), F.col("y")), "w")
    return models.score_task(o, model, "answer", ["no", "yes"]).select("o_orderkey", "final", "imputed", "was_imputed", r(F.col("confidence"), "confidence"))


@query()
def calibration_line(spark, folder):
    slope, intercept = models.calibration_line(_orders(spark, folder), "y", "p", "w")
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")


@query()
def isotonic_calibrate(spark, folder):
    return models.isotonic_calibrate(_orders(spark, folder), "y", "p", "w").select("o_orderkey", "calibrated")


@query()
def density_ratio_reweight(spark, folder):
    o = models.encode(_orders(spark, folder), {"o_orderpriority": PRIORITIES}, ["p"]).withColumn("other_wave", F.col("y") == 1)
    return models.weight_report(models.density_ratio_reweight(o, "other_wave", "w"), "ratio_weight")


@query()
def select_one_se(spark, folder):
    o = models.encode(_orders(spark, folder), {"o_orderpriority": PRIORITIES}, ["p"]).withColumn("fold", F.col("o_custkey") % 3)
    losses = models.grid_cv(o, F.col("y"), "w", "fold", 3, [0.0, 0.01, 0.5])
    return models.select_one_se(losses, "penalty", "penalty")


@query()
def rubin_interval(spark, folder):
    draws = _orders(spark, folder).groupBy("o_orderpriority", (F.col("o_orderkey") % 8).alias("draw")).agg(F.avg("y").alias("e"), (F.var_samp("y") / F.count("*")).alias("v"))
    return models.rubin_interval(imputation.rubin(draws, "o_orderpriority", "e", "v"))


SPOTS = "SELECT s_suppkey, s_suppkey * 37 % 1300 / 100.0 - 1.503 AS x, s_suppkey * 71 % 1300 / 100.0 - 1.504 AS y FROM supplier"


@query(
    f"""WITH p AS ({SPOTS}), z AS (SELECT n_nationkey AS zone, n_nationkey % 5 * 2 + 1.3 AS cx, n_nationkey // 5 * 2 + 1.1 AS cy FROM nation),
e AS (SELECT zone, cx + dx AS ax, cy + dy AS ay, cx + ex AS bx, cy + ey AS b_y FROM z, (VALUES (-0.9, 0.0, 0.0, 0.9), (0.0, 0.9, 0.9, 0.0), (0.9, 0.0, 0.0, -0.9), (0.0, -0.9, -0.9, 0.0)) v(dx, dy, ex, ey)),
t AS (SELECT s_suppkey, zone, x, y, ax, ay, bx, b_y, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) AS k FROM p, e),
d AS (SELECT s_suppkey, zone, min(sqrt((x - ax - k * (bx - ax)) ** 2 + (y - ay - k * (b_y - ay)) ** 2)) AS d FROM t GROUP BY ALL)
SELECT s_suppkey, zone, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(d, 9), zone) AS n
  FROM (SELECT s_suppkey, zone, CASE WHEN abs(x - cx) + abs(y - cy) < 0.9 THEN 0 ELSE d END AS d FROM d JOIN p USING (s_suppkey) JOIN z USING (zone))) WHERE n = 1"""
)
def nearest_polygon(spark, folder):
    at = lambda k: F.col("s_suppkey") * k % 1300 / 100.0
    points = read(spark, folder, "supplier").select("s_suppkey", (at(37) - 1.503).alias("x"), (at(71) - 1.504).alias("y"))
    cx, cy = F.col("n_nationkey") % 5 * 2 + 1.3, F.floor(F.col("n_nationkey") / 5) * 2 + 1.1
    corner = lambda dx, dy: F.struct((cx + dx).cast("double").alias("x"), (cy + dy).cast("double").alias("y"))
    ring = F.array(corner(-0.9, 0.0), corner(0.0, 0.9), corner(0.9, 0.0), corner(0.0, -0.9))
    diamonds = read(spark, folder, "nation").select(F.col("n_nationkey").alias("zone"), ring.alias("ring"))
    return zones.nearest_polygon(points, diamonds, "s_suppkey").withColumn("distance", F.round("distance", 6))


@query(
    """WITH a AS (SELECT s_suppkey, s_nationkey, s_suppkey % 50 AS size, s_suppkey * 37 % 101 AS far FROM supplier),
n AS (SELECT *, sum(size) OVER (PARTITION BY s_nationkey ORDER BY far, s_suppkey) - size AS before FROM a) SELECT s_suppkey, s_nationkey FROM n WHERE before < 60"""
)
def nearest_until_enough(spark, folder):
    a = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 50).alias("size"), (F.col("s_suppkey") * 37 % 101).alias("far"))
    need = a.select("s_nationkey").distinct().withColumn("need", F.lit(60))
    return zones.nearest_until_enough(a, need, "s_nationkey", ["far", "s_suppkey"], "size", "need").select("s_suppkey", "s_nationkey")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey WHEN c_custkey % 6 = 1 THEN 100 + c_nationkey END AS zone,
  CASE WHEN c_custkey % 4 = 0 THEN 'survey' WHEN c_custkey % 6 = 1 THEN 'polygon' END AS rule FROM customer"""
)
def assign_units(spark, folder):
    c = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    known = {
        "survey": c.where("c_custkey % 4 = 0").select("c_custkey", F.col("c_nationkey").alias("zone")),
        "polygon": c.where("c_custkey % 6 = 1").select("c_custkey", (F.col("c_nationkey") + 100).alias("zone")),
    }
    return zones.assign_units(c.select("c_custkey"), "c_custkey", known)


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey % 9 AS zone, 1 + o_custkey % 5 AS residents, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 END AS aged FROM orders),
z AS (SELECT zone, sum(aged) FILTER (aged IS NOT NULL) / sum(residents) FILTER (aged IS NOT NULL) AS rate FROM o GROUP BY 1)
SELECT o_orderkey, round(coalesce(aged, rate * residents), 6) AS aged FROM o JOIN z USING (zone)"""
)
def fill_unaged(spark, folder):
    o = read(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 9).alias("zone"), (1 + F.col("o_custkey") % 5).alias("residents"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 4).alias("aged"),
    )
    return zones.fill_from_zone(o, "zone", "aged", "residents").select("o_orderkey", r(F.col("aged"), "aged"))


@query(
    """SELECT c_custkey, round(CASE WHEN c_custkey % 2000 = 0 THEN 1 ELSE greatest(1, least(3, c_acctbal / (c_custkey % 2000))) END, 6) AS scale FROM customer"""
)
def dwelling_scale(spark, folder):
    c = read(spark, folder, "customer")
    return c.select("c_custkey", r(zones.scale(F.col("c_acctbal"), F.col("c_custkey") % 2000, 1.0, 3.0), "scale"))


@query()
def compare_training_populations(spark, folder):
    o = models.encode(_orders(spark, folder), {"o_orderpriority": PRIORITIES}, ["p", "kilo"])
    populations = {"all": F.lit(True), "open": F.col("o_orderstatus") == "O", "dear": F.col("kilo") > 100}
    out = models.compare_training_populations(o, populations, F.col("o_custkey") % 5 == 0, F.col("y"), "w")
    return out.withColumn("log_loss", F.round("log_loss", 4))


@query(
    """WITH o AS (SELECT 1 + o_custkey % 7 AS w, exp((o_orderkey * 37 % 1000) / 400.0) AS odds FROM orders),
q AS (SELECT (SELECT min(odds) FROM (SELECT odds, sum(count(*)) OVER (ORDER BY odds) AS t, sum(count(*)) OVER () AS a FROM o GROUP BY odds) WHERE t >= 0.5 * a - 1e-9) AS m,
  (SELECT min(odds) FROM (SELECT odds, sum(count(*)) OVER (ORDER BY odds) AS t, sum(count(*)) OVER () AS a FROM o GROUP BY odds) WHERE t >= 0.9 * a - 1e-9) AS p)
SELECT count(*) AS "rows", round(sum(w * odds) ** 2 / sum((w * odds) ** 2), 4) AS effective, round(sum(w * odds) FILTER (odds >= p) / sum(w * odds), 6) AS top_decile_share,
  round(any_value(m), 6) AS odds_median, round(any_value(p), 6) AS odds_p90 FROM o, q"""
)
def density_report(spark, folder):
    o = read(spark, folder, "orders").select((1 + F.col("o_custkey") % 7).alias("w"), F.exp((F.col("o_orderkey") * 37 % 1000) / 400.0).alias("odds"))
    got = models.density_report(o, "w", "odds")
    return got.select("rows", F.round("effective", 4).alias("effective"), *[r(F.col(c), c) for c in ("top_decile_share", "odds_median", "odds_p90")])


@query()
def search_models(spark, folder):
    """Three families over three group folds, the simplest within one standard error chosen."""
    o = _orders(spark, folder)
    split = models.stratified_group_folds(o, "o_custkey", "y", 3, 5)
    d = models.encode(o.join(split, "o_custkey"), {"o_orderpriority": PRIORITIES}, ["p", "kilo"])
    specs = {
        "logistic, strong": ("logistic", {"regParam": 1.0}), "logistic": ("logistic", {"regParam": 0.001}),
        "forest": ("forest", {"numTrees": 10, "maxDepth": 4}), "boosting": ("boosting", {"maxIter": 5}),
    }
    losses = models.search_models(d, F.col("y"), "w", "fold", 3, 2, specs)
    return models.choose_model(losses).select("config", r(F.col("mean"), "mean"), r(F.col("gap"), "gap"), "chosen")


@query()
def stratified_group_folds(spark, folder):
    """(o_custkey, fold) of orders by whole customers."""
    return models.stratified_group_folds(_orders(spark, folder), "o_custkey", "y", 4, 5)
