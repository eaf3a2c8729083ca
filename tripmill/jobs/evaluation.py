"""Registered queries on the evaluation of class probabilities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import metrics
from tripmill.sources.tables import read

from .queries import query

#: Probabilities of the return flags that depend on keys only.
GUESSES = """g AS (SELECT l_returnflag AS t, CAST(l_quantity AS DOUBLE) AS w, (l_orderkey % 50 + 1) / 202.0 AS a, ((l_partkey * 7 + l_suppkey) % 100 + 1) / 202.0 AS r FROM lineitem),
p AS (SELECT t, w, a::DOUBLE AS a, (1 - a - r)::DOUBLE AS n, r::DOUBLE AS r, CASE WHEN a >= 1 - a - r AND a >= r THEN 'A' WHEN 1 - a - r >= r THEN 'N' ELSE 'R' END AS g FROM g)"""
FLAGS = {"A": "a", "N": "n", "R": "r"}


def _guesses(spark, folder):
    a, r = (F.col("l_orderkey") % 50 + 1) / 202.0, ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100 + 1) / 202.0
    return read(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("t"), F.col("l_quantity").cast("double").alias("w"), a.alias("a"), (1 - a - r).alias("n"), r.alias("r")
    )


_CLASSES = """c AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(c)),
s AS (SELECT c, count(*) FILTER (t = c) AS s, count(*) FILTER (p.g = c) AS q, count(*) FILTER (t = c AND p.g = c) AS h,
    sum(w) FILTER (t = c) AS ws, sum(w) FILTER (p.g = c) AS wq, sum(w) FILTER (t = c AND p.g = c) AS wh FROM p, c GROUP BY c)"""


@query(
    f"""WITH {GUESSES}, {_CLASSES},
x AS (SELECT sum(h) / sum(s) AS accuracy, avg(coalesce(h, 0) / s) AS balanced_accuracy, avg(2 * coalesce(h, 0) / (s + q)) AS f1_macro, sum(wh) / sum(ws) AS weighted_accuracy,
    avg(coalesce(wh, 0) / ws) AS weighted_balanced_accuracy, avg(2 * coalesce(wh, 0) / (ws + coalesce(wq, 0))) AS weighted_f1_macro FROM s),
y AS (SELECT sum(-w * ln(CASE t WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END)) / sum(w) AS weighted_log_loss, sum(w * (r - (t = 'R')::INT) ** 2) / sum(w) AS weighted_brier_score,
    2 * sum(w) FILTER (t = 'R' AND r >= 0.4) / (sum(w) FILTER (t = 'R') + sum(w) FILTER (r >= 0.4)) AS weighted_f1, sum(w) FILTER (t = 'R') / sum(w) AS observed_rate, sum(w * r) / sum(w) AS predicted_rate FROM p),
d AS (SELECT r, coalesce(sum(w) FILTER (t = 'R'), 0) AS wp, coalesce(sum(w) FILTER (t <> 'R'), 0) AS wn FROM p GROUP BY r),
z AS (SELECT sum(wp * (below + wn / 2)) / (sum(wp) * sum(wn)) AS weighted_roc_auc FROM (SELECT *, sum(wn) OVER (ORDER BY r) - wn AS below FROM d)),
wide AS (SELECT *, (predicted_rate - observed_rate) * 100 AS calibration_gap_pp FROM x, y, z)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT wide ON COLUMNS(*) INTO NAME metric VALUE value)"""
)
def classifier_evaluation(spark, folder):
    return metrics.evaluate_classifier(_guesses(spark, folder), "t", FLAGS, "w", "R", 0.4).select("metric", F.round("value", 6).alias("value"))


@query(
    f"""WITH {GUESSES}, {_CLASSES}
SELECT c AS class, round(ws / (SELECT sum(w) FROM p), 6) AS observed, round(coalesce(wq, 0) / (SELECT sum(w) FROM p), 6) AS hard, round(e / (SELECT sum(w) FROM p), 6) AS probabilistic,
  round((e - ws) / (SELECT sum(w) FROM p) * 100, 6) AS difference_pp
FROM s JOIN (SELECT 'A' AS c, sum(w * a) AS e FROM p UNION ALL SELECT 'N', sum(w * n) FROM p UNION ALL SELECT 'R', sum(w * r) FROM p) USING (c)"""
)
def class_share_comparison(spark, folder):
    found = metrics.class_shares(_guesses(spark, folder), "t", FLAGS, "w")
    return found.select("class", *[F.round(c, 6).alias(c) for c in ("observed", "hard", "probabilistic", "difference_pp")])


@query(
    """WITH v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS w FROM lineitem), s AS (SELECT v, sum(w) AS w FROM v GROUP BY v),
r AS (SELECT v, sum(w) OVER (ORDER BY v) AS t, sum(w) OVER () AS a FROM s)
SELECT share, min(v) AS value FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) q(share) WHERE t >= share * a * (1 - 1e-12) GROUP BY share"""
)
def weighted_quantiles(spark, folder):
    v = read(spark, folder, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v"), F.col("l_quantity").cast("double").alias("w"))
    return metrics.weighted_quantiles(v, "v", "w", [0.1, 0.5, 0.9])
