"""Weighted classifiers over declared levels, their marginalisation and calibration.

Fits use Spark ML; what reaches the driver is bounded by levels, configurations and folds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import stage

from .metrics import weighted_quantiles

#: Probabilities are grouped at this many decimals where a global order is needed, which
#: bounds the rows of that order by a million and one, whatever the input.
DECIMALS = 6


def encode(df: DataFrame, categorical: dict[str, Sequence[str]], numeric: Sequence[str] = ()) -> DataFrame:
    """`features`: an indicator of every level but the first, then the numbers (null is 0)."""
    parts = {f"_{c}_{i}": (F.col(c).eqNullSafe(F.lit(v))).cast("double") for c, levels in categorical.items() for i, v in enumerate(levels) if i}
    parts |= {f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    return VectorAssembler(inputCols=list(parts), outputCol="features").transform(df.withColumns(parts)).drop(*parts)


def fit(df: DataFrame, label: Column, weight: str, penalty: float = 0.0) -> LogisticRegressionModel:
    """Weighted logistic model of a class number, over what encode() returns."""
    known = df.select("features", label.cast("double").alias("label"), F.col(weight).cast("double").alias("weight")).where("label IS NOT NULL")
    return LogisticRegression(weightCol="weight", regParam=penalty, maxIter=100, tol=1e-6).fit(known)


def fit_arms(df: DataFrame, arms: dict[str, tuple[str, dict[str, Sequence[str]], Sequence[str]]], label: Column, weight: str, classes: int, seed: int = 1) -> dict:
    """A fitted weighted model for each arm: (kind, categorical features with their levels,
    numeric features); kind is logistic, forest or boosting (one against the rest where
    there are more than two classes)."""
    out = {}
    for name, (kind, categorical, numeric) in arms.items():
        known = encode(df.withColumns({"label": label.cast("double"), "weight": F.col(weight).cast("double")}), categorical, numeric)
        known = known.select("features", "label", "weight").where("label IS NOT NULL")
        if kind == "logistic":
            model = LogisticRegression(weightCol="weight", maxIter=100, tol=1e-6)
        elif kind == "forest":
            model = RandomForestClassifier(weightCol="weight", numTrees=50, maxDepth=8, seed=seed)
        elif kind == "boosting":
            trees = GBTClassifier(weightCol="weight", maxIter=20, maxDepth=4, seed=seed)
            model = trees if classes == 2 else OneVsRest(classifier=trees, weightCol="weight")
        else:
            raise ValueError(f"no model of kind {kind}")
        out[name] = model.fit(known)
    return out


def compare_training_populations(
    df: DataFrame, populations: dict[str, Column], held_out: Column, label: Column, weight: str, clip: float = 1e-12
) -> DataFrame:
    """(population, rows, log_loss): the weighted log loss on the same held-out rows of models
    fitted on each population's other rows. Takes what encode() returns."""
    d = df.withColumns({"_y": label.cast("int"), "_out": F.coalesce(held_out, F.lit(False))}).where("_y IS NOT NULL")
    parts = []
    for name, test in populations.items():
        train = d.where(~F.col("_out") & test)
        scored = fit(train, F.col("_y"), weight).transform(d.where("_out"))
        q = F.greatest(F.coalesce(F.get(vector_to_array("probability"), F.col("_y")), F.lit(0.0)), F.lit(clip))
        loss = scored.agg((-F.sum(F.col(weight) * F.log(q)) / F.sum(weight)).alias("log_loss"))
        rows = train.agg(F.count("*").alias("rows"))
        parts.append(rows.crossJoin(F.broadcast(loss)).select(F.lit(name).alias("population"), "rows", "log_loss"))
    return reduce(DataFrame.unionByName, parts)


def score_task(df: DataFrame, model: LogisticRegressionModel, observed: str, classes: Sequence[str]) -> DataFrame:
    """Adds probabilities (one-hot where the answer is observed), imputed, final,
    was_imputed and confidence."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    hot = F.array(*[(F.col(observed) == c).cast("double") for c in classes])
    out = out.withColumn("probabilities", F.when(F.col(observed).isNull(), F.col("_p")).otherwise(hot))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return out.withColumns(
        {
            "imputed": F.element_at(F.array(*map(F.lit, classes)), best), "was_imputed": F.col(observed).isNull(),
            "confidence": F.array_max("probabilities"),
        }
    ).withColumn("final", F.coalesce(observed, "imputed")).drop("_p", "rawPrediction", "probability", "prediction")


def level_shares(df: DataFrame, level: str, weight: str) -> DataFrame:
    """(level, share): weighted share of each observed level."""
    cells = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.sum(weight).alias("w"))
    return cells.select(level, (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("share"))


def marginalize_unsupported(df: DataFrame, key: str, shares: dict[str, DataFrame], score: Callable[[DataFrame], Column], most: int = 10_000) -> DataFrame:
    """(key, p, features): rows whose value of a feature no training row has are spread
    over the supported levels by their shares, scored once each, and summed back.

    shares holds (level, share) by feature; their sizes are declared levels, and a product
    of them above `most` is an error. features names what was marginalised.
    """
    out, names, product = df.withColumn("_w", F.lit(1.0)), [], 1
    for feature, table in shares.items():
        levels = [F.struct(F.lit(r[feature]).alias("v"), F.lit(float(r["share"])).alias("s")) for r in table.limit(most + 1).collect()]
        product *= max(1, len(levels))
        if product > most:
            raise ValueError(f"more than {most} combinations of levels")
        every = F.array(*levels)
        known = F.coalesce(F.array_contains(every.getField("v"), F.col(feature)), F.lit(False))
        names.append(F.when(~known, feature))
        own = F.array(F.struct(F.col(feature).alias("v"), F.lit(1.0).alias("s")))
        out = out.withColumn(f"_miss_{feature}", names[-1]).withColumn("_x", F.explode(F.when(known, own).otherwise(every)))
        out = out.withColumn(feature, F.col("_x.v")).withColumn("_w", F.col("_w") * F.col("_x.s")).drop("_x")
    missed = F.array_join(F.array_compact(F.array(*[F.col(f"_miss_{f}") for f in shares])), "+")
    return out.withColumn("_p", score(out)).groupBy(key).agg(F.sum(F.col("_w") * F.col("_p")).alias("p"), F.first(missed).alias("features"))


def adjust_share(df: DataFrame, p: str, weight: str, target: float) -> DataFrame:
    """p scaled by one factor, clipped at 1, so that its weighted mean is target; a target
    that no factor reaches gives 1 wherever p is positive.

    With the largest probabilities clipped, the factor is what is left of the target over
    the rest's sum; the first such factor that leaves the next probability below 1 is it.
    """
    cells = df.where(F.col(p).isNotNull()).groupBy(F.round(p, DECIMALS).alias("q")).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(p)).alias("wp"))
    above = Window.partitionBy().orderBy(F.desc("q"))
    whole = Window.partitionBy()
    ran = cells.select(
        "q", (F.sum("w").over(above) - F.col("w")).alias("clipped"), F.sum("w").over(whole).alias("all"),
        (F.sum("wp").over(whole) - F.sum("wp").over(above) + F.col("wp")).alias("rest"),
    )
    ran = ran.withColumn("f", (F.lit(target) * F.col("all") - F.col("clipped")) / F.nullif("rest", F.lit(0.0)))
    factor = ran.where("f * q <= 1").agg(F.max_by("f", "q").alias("_f"))
    scaled = F.when(F.col(p) > 0, F.least(F.lit(1.0), F.col(p) * F.coalesce("_f", F.lit(float("inf"))))).otherwise(F.col(p))
    return df.crossJoin(F.broadcast(factor)).withColumn("adjusted", scaled).drop("_f")


def calibration_line(df: DataFrame, y: str, p: str, weight: str) -> tuple[float, float]:
    """(slope, intercept) of a weighted logistic model of y on the logit of p."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    x = VectorAssembler(inputCols=["_x"], outputCol="features").transform(df.withColumn("_x", F.log(q / (1 - q))))
    model = fit(x, F.col(y), weight)
    return float(model.coefficients[0]), float(model.intercept)


def isotonic_calibrate(df: DataFrame, y: str, p: str, weight: str) -> DataFrame:
    """`calibrated`: the isotonic regression of y on p. It is fitted on weighted means of y
    at each p of DECIMALS decimals, as the fit ends on one task."""
    cells = df.groupBy(F.round(p, DECIMALS).alias("x")).agg(F.sum(weight).cast("double").alias("weight"), (F.sum(F.col(weight) * F.col(y)) / F.sum(weight)).alias("label"))
    model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(cells)
    return model.transform(df.withColumn("x", F.round(p, DECIMALS))).drop("x")


def density_ratio_reweight(df: DataFrame, is_target: str, weight: str) -> DataFrame:
    """The source rows with `odds`, those of a row like them being a target row, and
    `ratio_weight`, their weight times the odds, rescaled to the sum of their weights. Takes
    what encode() returns."""
    model = fit(df, F.col(is_target).cast("int"), weight)
    p = vector_to_array("probability")[1]
    source = model.transform(df.where(~F.col(is_target))).withColumn("odds", p / (1 - p)).withColumn("_o", F.col(weight) * F.col("odds"))
    scale = source.agg((F.sum(weight) / F.sum("_o")).alias("_k"))
    return source.crossJoin(F.broadcast(scale)).withColumn("ratio_weight", F.col("_o") * F.col("_k")).drop("_o", "_k", "rawPrediction", "probability", "prediction")


def within_support(target: DataFrame, source: DataFrame, features: Sequence[str], missing: str = "missing") -> DataFrame:
    """target with the values of features that no source row has set to the missing label,
    so that a density ratio is not fitted on a level that one side lacks."""
    out = target
    for c in features:
        held = source.where(F.col(c).isNotNull()).select(F.col(c).alias(f"_has_{c}")).distinct()
        out = out.join(held, F.col(c) == F.col(f"_has_{c}"), "left").withColumn(c, F.coalesce(F.col(f"_has_{c}"), F.lit(missing))).drop(f"_has_{c}")
    return out


def density_report(df: DataFrame, weight: str, odds: str) -> DataFrame:
    """(rows, effective, top_decile_share, odds_median, odds_p90) of source rows whose new
    weight is weight times odds: the effective sample size, the share of weight of the
    tenth of rows with the largest odds, and quantiles of the odds (the least value that
    the share of rows reaches), by cells of their range instead of a global order."""
    d = df.select(F.col(odds).cast("double").alias("o"), (F.col(weight) * F.col(odds)).cast("double").alias("n"), F.lit(1.0).alias("one"))
    at = weighted_quantiles(d, "o", "one", [0.5, 0.9]).agg(
        F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("odds_median"), F.max(F.when(F.col("share") == 0.9, F.col("value"))).alias("odds_p90")
    )
    sums = d.crossJoin(F.broadcast(at)).agg(
        F.count("*").alias("rows"), (F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("effective"),
        (F.sum(F.when(F.col("o") >= F.col("odds_p90"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("top_decile_share"),
    )
    return sums.crossJoin(F.broadcast(at))


def weight_report(df: DataFrame, weight: str) -> DataFrame:
    """(rows, effective, largest_share): effective sample size and the largest weight's share."""
    return df.agg(
        F.count("*").alias("rows"), (F.pow(F.sum(weight), 2) / F.sum(F.col(weight) * F.col(weight))).alias("effective"),
        (F.max(weight) / F.sum(weight)).alias("largest_share"),
    )


def grid_cv(df: DataFrame, label: Column, weight: str, fold: str, folds: int, penalties: Sequence[float], clip: float = 1e-12) -> DataFrame:
    """(penalty, fold, log_loss): weighted log loss of each configuration on each fold."""
    parts = []
    d = df.withColumn("_y", label.cast("int")).where("_y IS NOT NULL")
    for penalty in penalties:
        for k in range(folds):
            scored = fit(d.where(F.col(fold) != k), F.col("_y"), weight, penalty).transform(d.where(F.col(fold) == k))
            q = F.greatest(F.get(vector_to_array("probability"), F.col("_y")), F.lit(clip))
            parts.append(scored.agg(F.lit(float(penalty)).alias("penalty"), F.lit(k).alias("fold"), (-F.sum(F.col(weight) * F.log(q)) / F.sum(weight)).alias("log_loss")))
    return reduce(DataFrame.unionByName, parts)


def search_models(
    df: DataFrame, label: Column, weight: str, fold: str, folds: int, classes: int, specs: dict[str, tuple[str, dict]], workers: int = 4, clip: float = 1e-12
) -> DataFrame:
    """(config, order, fold, log_loss): weighted log loss of every configuration on every
    fold, over several families. specs: name -> (family, parameters), simplest first;
    families are logistic, forest and boosting. Takes what encode() returns.

    The encoded rows are written once and read by all fits, which run side by side from a
    few threads; what comes back is one number for each.
    """
    d = stage(df.select("features", label.cast("int").alias("label"), F.col(weight).cast("double").alias("weight"), F.col(fold).cast("int").alias("fold")).where("label IS NOT NULL"))

    def build(family: str, given: dict):
        made = {
            "logistic": lambda: LogisticRegression(**({"weightCol": "weight", "maxIter": 100, "tol": 1e-6} | given)),
            "forest": lambda: RandomForestClassifier(**({"weightCol": "weight", "numTrees": 30, "maxDepth": 6, "seed": 1} | given)),
            "boosting": lambda: GBTClassifier(**({"weightCol": "weight", "maxIter": 15, "maxDepth": 3, "seed": 1} | given)),
        }
        if family not in made:
            raise ValueError(f"no family {family}")
        one = made[family]()
        return one if family != "boosting" or classes == 2 else OneVsRest(classifier=one, weightCol="weight")

    def loss(job: tuple[int, str, int]) -> tuple:
        order, name, k = job
        scored = build(*specs[name]).fit(d.where(F.col("fold") != k)).transform(d.where(F.col("fold") == k))
        if "probability" in scored.columns:
            p = vector_to_array("probability")
        else:  # one against the rest gives raw scores only: their logistic, scaled to one
            raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
            p = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))
        q = F.greatest(F.coalesce(F.get(p, F.col("label")), F.lit(0.0)), F.lit(clip))
        value = scored.agg(-F.sum(F.col("weight") * F.log(q)) / F.sum("weight")).first()[0]
        return name, order, k, float(value)

    jobs = [(order, name, k) for order, name in enumerate(specs) for k in range(folds)]
    with ThreadPoolExecutor(workers) as pool:
        found = list(pool.map(loss, jobs))
    return df.sparkSession.createDataFrame(found, "config string, `order` int, fold int, log_loss double")


def choose_model(losses: DataFrame) -> DataFrame:
    """select_one_se() over search_models(): the first configuration, in the order given,
    whose paired gap to the best is within one standard error."""
    named = losses.withColumn("simpler", -F.col("order"))
    return select_one_se(named, "config", "simpler")


def stratified_group_folds(df: DataFrame, group: str, target: str, folds: int, seed: int = 0, most: int = 100_000) -> DataFrame:
    """(group, fold): folds with like shares of every class, a group's rows in one fold.

    Groups of equal class counts are alike, so the greedy choice is made for each kind of
    group (`most` kinds at most), not for each group: kinds with the most uneven counts go
    first, whole rounds over the folds, and each group left over to the fold where the
    classes then spread least. Within a kind, groups are dealt by the hash of their name.
    """
    counts = df.groupBy(group, target).agg(F.count("*").alias("n"))
    kinds = counts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(target).cast("string").alias("t"), "n"))).alias("kind"))
    kinds = stage(kinds.select(group, F.to_json("kind").alias("kind")))
    table = kinds.groupBy("kind").agg(F.count("*").alias("groups")).limit(most + 1).collect()
    if len(table) > most:
        raise ValueError(f"more than {most} kinds of groups")
    parsed = [({x["t"]: x["n"] for x in json.loads(r["kind"])}, r["groups"], r["kind"]) for r in table]
    labels = sorted({c for by, _, _ in parsed for c in by})
    totals = {c: sum(by.get(c, 0) * n for by, n, _ in parsed) for c in labels}
    spread = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v))
    parsed.sort(key=lambda x: (-spread([x[0].get(c, 0) for c in labels]), x[2]))
    held = [dict.fromkeys(labels, 0) for _ in range(folds)]
    deal = []
    for by, n, kind in parsed:
        quota = [n // folds] * folds
        for k in range(folds):
            for c in labels:
                held[k][c] += by.get(c, 0) * quota[k]
        for _ in range(n % folds):
            def worth(k: int) -> tuple:
                after = [spread([(held[j][c] + (by.get(c, 0) if j == k else 0)) / max(totals[c], 1) for j in range(folds)]) for c in labels]
                return sum(after) / len(after), sum(held[k].values()), k

            best = min((k for k in range(folds) if quota[k] == n // folds), key=worth)
            quota[best] += 1
            for c in labels:
                held[best][c] += by.get(c, 0)
        ends, ran = [], 0
        for q in quota:
            ran += q
            ends.append(ran)
        deal.append((kind, ends))
    spark = df.sparkSession
    if not deal:
        return kinds.select(group, F.lit(0).alias("fold"))
    h = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed))))
    # places within a kind: counts of hash blocks before, then the place in the block
    blocks = kinds.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    sizes = blocks.groupBy("kind", "_b").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("kind").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    placed = blocks.join(sizes, ["kind", "_b"]).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("kind", "_b").orderBy("_h", group)) - 1)
    ends = spark.createDataFrame(deal, "kind string, ends array<long>")
    return placed.join(ends, "kind").select(group, F.size(F.filter("ends", lambda e: e <= F.col("_at"))).alias("fold"))


def select_one_se(losses: DataFrame, config: str, simpler: str, fold: str = "fold", loss: str = "log_loss") -> DataFrame:
    """(config, simpler, mean, gap, se, chosen): of the configurations whose paired gap to
    the best is within one standard error, the simplest (largest `simpler`)."""
    means = losses.groupBy(config, simpler).agg(F.avg(loss).alias("mean")) if config != simpler else losses.groupBy(config).agg(F.avg(loss).alias("mean"))
    best = means.agg(F.min(F.struct("mean", config)).alias("b")).select(F.col(f"b.{config}").alias("_best"))
    at_best = losses.join(F.broadcast(best), F.col(config) == F.col("_best")).select(fold, F.col(loss).alias("_least"))
    gaps = losses.join(at_best, fold).groupBy(config).agg(
        F.avg(F.col(loss) - F.col("_least")).alias("gap"), (F.stddev_samp(F.col(loss) - F.col("_least")) / F.sqrt(F.count("*"))).alias("se")
    )
    out = means.join(gaps, config).withColumn("_in", F.col("gap") <= F.coalesce("se", F.lit(0.0)))
    top = F.max(F.when(F.col("_in"), F.col(simpler))).over(Window.partitionBy())
    return out.withColumn("chosen", F.col("_in") & (F.col(simpler) == top)).drop("_in")


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its distribution function, which Simpson's
    rule integrates over the angle atan(t / sqrt(df))."""
    if not df > 0 or math.isnan(df):
        return math.nan
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    if df > 1e6:  # normal to seven digits
        df, scale = 1e6, math.sqrt(1e6 / (2 * math.pi))

    def cdf(t: float) -> float:
        top, n = math.atan(t / math.sqrt(df)), 2000
        h = top / n
        f = lambda a: math.cos(a) ** (df - 1)
        s = f(0) + f(top) + 4 * sum(f(h * i) for i in range(1, n, 2)) + 2 * sum(f(h * i) for i in range(2, n, 2))
        return 0.5 + scale * s * h / 3

    lo, hi = 0.0, 1.0
    while cdf(hi) < p and hi < 1e9:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def rubin_interval(pooled: DataFrame, level: float = 0.95) -> DataFrame:
    """low and high of the interval around `mean`, by the t quantile of `df` and the root
    of `total`; the normal quantile where df is null. Takes what rubin() returns: one row
    for each group."""

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        return df.map(lambda v: t_quantile((1 + level) / 2, 1e9 if pd.isna(v) else v))

    half = quantile(F.col("df").cast("double")) * F.sqrt("total")
    return pooled.withColumn("_h", half).withColumn("low", F.col("mean") - F.col("_h")).withColumn("high", F.col("mean") + F.col("_h")).drop("_h")
