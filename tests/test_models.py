"""Fits, calibration and nearest zones on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from tripmill.operators import imputation, models, zones


@pytest.mark.parametrize(("p", "df", "t"), [(0.975, 10, 2.228139), (0.975, 1, 12.706205), (0.95, 30, 1.697261), (0.975, 1e9, 1.959964)])
def test_t_quantile(p, df, t):
    assert models.t_quantile(p, df) == pytest.approx(t, abs=1e-5)


def test_rubin_interval(spark):
    df = spark.createDataFrame([("a", 0.3, 0.01), ("a", 0.4, 0.01), ("a", 0.5, 0.01), ("b", 0.2, 0.04), ("b", 0.2, 0.04)], "g string, e double, v double")
    got = {r.g: r for r in models.rubin_interval(imputation.rubin(df, "g", "e", "v")).collect()}
    half = models.t_quantile(0.975, got["a"].df) * math.sqrt(0.01 + 0.01 * 4 / 3)
    assert got["a"].low == pytest.approx(0.4 - half) and got["a"].high == pytest.approx(0.4 + half)
    assert got["b"].high == pytest.approx(0.2 + 1.959964 * 0.2, abs=1e-5)


def test_adjust_share_reaches_its_target(spark):
    df = spark.range(1000).select("id", (F.col("id") / 1000).alias("p"), (1 + F.col("id") % 3).cast("double").alias("w"))
    for target in (0.2, 0.5, 0.9):
        mean = models.adjust_share(df, "p", "w", target).agg(F.sum(F.col("adjusted") * F.col("w")) / F.sum("w")).first()[0]
        assert mean == pytest.approx(target, abs=1e-6)
    assert models.adjust_share(df.limit(0), "p", "w", 0.5).count() == 0


def test_calibration_line_of_true_probabilities(spark):
    rows = [(1, p, p) for p in (0.1, 0.3, 0.5, 0.8)] + [(0, p, 1 - p) for p in (0.1, 0.3, 0.5, 0.8)]
    slope, intercept = models.calibration_line(spark.createDataFrame(rows, "y int, p double, w double"), "y", "p", "w")
    assert slope == pytest.approx(1, abs=1e-3) and intercept == pytest.approx(0, abs=1e-3)


def test_isotonic_calibrate_does_not_fall(spark):
    df = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.2, 1.0), (0, 0.3, 1.0), (1, 0.9, 1.0)], "y int, p double, w double")
    got = [r.calibrated for r in models.isotonic_calibrate(df, "y", "p", "w").orderBy("p").collect()]
    assert got == pytest.approx([0, 0.5, 0.5, 1])


def test_marginalize_has_a_cap(spark):
    df = spark.createDataFrame([(1, "x")], "k long, f string")
    shares = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "f string, share double")
    got = models.marginalize_unsupported(df, "k", {"f": shares}, lambda _: F.when(F.col("f") == "a", 1.0).otherwise(0.0)).collect()
    assert [(r.k, r.p, r.features) for r in got] == [(1, 0.25, "f")]
    with pytest.raises(ValueError, match="combinations"):
        models.marginalize_unsupported(df, "k", {"f": shares}, lambda _: F.lit(1.0), most=1)


def test_nearest_polygon_far_away_and_empty(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    polygons = spark.createDataFrame([(7, ring)], "zone long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 101.0, 1.0), (3, None, 0.0)], "id long, x double, y double")
    got = {r.id: (r.zone, r.distance) for r in zones.nearest_polygon(points, polygons, "id").collect()}
    assert got == {1: (7, 0.0), 2: (7, 100.0)}
    assert zones.nearest_polygon(points, polygons.limit(0), "id").count() == 0


def test_score_task_keeps_answers(spark):
    rows = [(k, "a" if k % 2 else "b", ("yes" if k % 2 else "no") if k < 80 else None, 1.0) for k in range(100)]
    df = models.encode(spark.createDataFrame(rows, "k long, x string, answer string, w double"), {"x": ["a", "b"]})
    model = models.fit(df, F.when(F.col("answer").isNotNull(), (F.col("answer") == "yes").cast("int")), "w", 0.01)
    got = {r.k: r for r in models.score_task(df, model, "answer", ["no", "yes"]).collect()}
    assert all(r.final == ("yes" if k % 2 else "no") and r.was_imputed == (k >= 80) for k, r in got.items())
    assert got[0].probabilities == [1.0, 0.0] and 0.5 < got[81].confidence < 1


def test_density_ratio_moves_the_source_to_the_target(spark):
    rows = [(k % 4 == 0, "s", 1.0, False) for k in range(400)] + [(k % 4 != 0, "t", 1.0, True) for k in range(400)]
    df = spark.createDataFrame([("y" if x else "n", w, t) for x, _, w, t in rows], "x string, w double, target boolean")
    out = models.density_ratio_reweight(models.encode(df, {"x": ["n", "y"]}), "target", "w")
    share, total = out.agg(F.sum(F.when(F.col("x") == "y", F.col("ratio_weight"))) / F.sum("ratio_weight"), F.sum("ratio_weight")).first()
    assert share == pytest.approx(0.75, abs=0.01) and total == pytest.approx(400)


def test_select_one_se_takes_the_simplest(spark):
    losses = {0.0: (0.50, 0.52, 0.51), 0.1: (0.505, 0.518, 0.513), 1.0: (0.60, 0.61, 0.66)}
    df = spark.createDataFrame([(c, k, v) for c, vs in losses.items() for k, v in enumerate(vs)], "penalty double, fold int, log_loss double")
    got = {r.penalty: r for r in models.select_one_se(df, "penalty", "penalty").collect()}
    assert [c for c, r in got.items() if r.chosen] == [0.1] and got[0.0].gap == 0 and got[0.1].mean == pytest.approx(0.512)


def test_fit_arms_learn_a_rule(spark):
    rows = [(k % 3, float(k % 7), 1.0 + k % 2, "abc"[k % 3]) for k in range(210)]
    df = spark.createDataFrame(rows, "y int, z double, w double, x string")
    for classes, label in ((3, F.col("y")), (2, (F.col("y") == 1).cast("int"))):
        arms = {kind: (kind, {"x": ["a", "b", "c"]}, ["z"]) for kind in ("logistic", "forest", "boosting")}
        for name, model in models.fit_arms(df, arms, label, "w", classes).items():
            scored = model.transform(models.encode(df, {"x": ["a", "b", "c"]}, ["z"])).withColumn("l", label)
            assert scored.where("prediction <> l").count() == 0, name
    with pytest.raises(ValueError, match="kind"):
        models.fit_arms(df, {"x": ("net", {}, ["z"])}, F.col("y"), "w", 3)


def test_training_populations(spark):
    rows = [(k, "a" if k % 2 else "b", k % 2, 1.0) for k in range(200)]
    df = models.encode(spark.createDataFrame(rows, "k long, x string, y int, w double"), {"x": ["a", "b"]})
    out = models.compare_training_populations(df, {"all": F.lit(True), "wrong": (F.col("k") < 20)}, F.col("k") % 4 == 0, F.col("y"), "w")
    got = {r.population: r for r in out.collect()}
    assert got["all"].rows == 150 and got["wrong"].rows == 15 and got["all"].log_loss < 0.1


def test_search_over_families_equals_plain_fits(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "s").otherwise("t").alias("f"), (F.col("id") * 13 % 100 / 100).alias("x"), (F.col("id") % 3).cast("int").alias("fold"), F.lit(1.0).alias("w"))
    df = df.withColumn("y", ((F.col("id") * 7 % 100) < 100 * F.col("x")).cast("int"))
    d = models.encode(df, {"f": ["s", "t"]}, ["x"])
    specs = {"plain": ("logistic", {"regParam": 0.0}), "tree": ("forest", {"numTrees": 5, "maxDepth": 3}), "boost": ("boosting", {"maxIter": 3})}
    got = {(r.config, r.fold): r.log_loss for r in models.search_models(d, F.col("y"), "w", "fold", 3, 2, specs).collect()}
    plain = {r.fold: r.log_loss for r in models.grid_cv(d, F.col("y"), "w", "fold", 3, [0.0]).collect()}
    assert len(got) == 9 and all(got["plain", k] == pytest.approx(plain[k], abs=1e-4) for k in range(3))
    rows = [("a", 0, k, 0.50 + 0.01 * k) for k in range(3)] + [("b", 1, k, 0.49 + 0.02 * (k == 1)) for k in range(3)] + [("c", 2, k, 0.9) for k in range(3)]
    chosen = [r.config for r in models.choose_model(spark.createDataFrame(rows, "config string, `order` int, fold int, log_loss double")).where("chosen").collect()]
    assert chosen in (["a"], ["b"]) and len(chosen) == 1
    with pytest.raises(ValueError, match="no family"):
        models.search_models(d, F.col("y"), "w", "fold", 1, 2, {"x": ("net", {})})


def test_group_folds_share_classes_and_keep_groups(spark):
    df = spark.range(3000).select((F.col("id") % 211).alias("g"), F.when(F.col("id") % 211 < 30, "rare").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"))
    folds = models.stratified_group_folds(df, "g", "t", 5, 1)
    assert folds.count() == 211 and folds.select("g").distinct().count() == 211
    sizes = {}
    for r in df.join(folds, "g").groupBy("t", "fold").count().collect():
        sizes.setdefault(r.t, []).append(r["count"])
    assert all(len(v) == 5 and max(v) <= 1.35 * min(v) for v in sizes.values()), sizes
    assert models.stratified_group_folds(df.limit(0), "g", "t", 5).count() == 0


def test_density_diagnostics(spark):
    df = spark.createDataFrame([(float(k % 3 + 1), k / 10) for k in range(1, 41)], "w double, o double")
    got = models.density_report(df, "w", "o").first()
    rows = sorted((k / 10, float(k % 3 + 1)) for k in range(1, 41))
    new = [w * o for o, w in rows]
    assert (got.odds_median, got.odds_p90) == (2.0, 3.6) and got.effective == pytest.approx(sum(new) ** 2 / sum(x * x for x in new))
    assert got.top_decile_share == pytest.approx(sum(w * o for o, w in rows if o >= 3.6) / sum(new))
    target = spark.createDataFrame([(1, "x"), (2, "q"), (3, None)], "k long, f string")
    source = spark.createDataFrame([("x",), ("y",)], "f string")
    assert [(r.k, r.f) for r in models.within_support(target, source, ["f"]).orderBy("k").collect()] == [(1, "x"), (2, "missing"), (3, "missing")]


def test_weighted_auc_and_quantiles(spark):
    from tripmill.operators import metrics

    rows = [(k % 2, round((k * 7 % 11) / 10, 1), float(k % 4 + 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "y int, p double, w double")
    pos, neg = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    wins = sum(a[2] * b[2] * ((a[1] > b[1]) + 0.5 * (a[1] == b[1])) for a in pos for b in neg)
    want = wins / (sum(a[2] for a in pos) * sum(b[2] for b in neg))
    for cells in (1, 3, 4096):
        assert metrics.weighted_auc(df, "y", "p", "w", cells).first().auc == pytest.approx(want)
    assert metrics.weighted_auc(df.where("y = 1"), "y", "p", "w").first().auc is None
    for cells in (1, 2, 64):
        got = {r.share: r.value for r in metrics.weighted_quantiles(df, "p", "w", [0.1, 0.5, 1.0], cells).collect()}
        total = sum(r[2] for r in rows)
        for q, v in got.items():
            assert v == min(x for x in {r[1] for r in rows} if sum(r[2] for r in rows if r[1] <= x) >= q * total - 1e-9)
