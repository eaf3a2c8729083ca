"""Weighted evaluation of class probabilities, without a global order of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of [0, 1] in which ranks are made; what is below a cell is a sum over cells.
CELLS = 4096


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def weighted_auc(df: DataFrame, y: str, p: str, weight: str, cells: int = CELLS) -> DataFrame:
    """(positives, negatives, auc): area under the curve with ties at half, by weight; auc is
    null where either class has no weight.

    Rows are summed by distinct p before anything is ordered. The weight of negatives below
    p is that of lower cells (one row a cell) plus that of lower p within the cell.
    """
    w, pos = F.col(weight).cast("double"), F.col(y) == 1
    each = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("p")).agg(
        F.sum(F.when(pos, w).otherwise(0.0)).alias("wp"), F.sum(F.when(pos, 0.0).otherwise(w)).alias("wn")
    )
    each = each.withColumn("cell", F.least(F.greatest(F.floor(F.col("p") * cells), F.lit(0)), F.lit(cells)))
    sums = each.groupBy("cell").agg(F.sum("wn").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    sums = sums.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("low"))
    inside = F.coalesce(F.sum("wn").over(Window.partitionBy("cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = each.join(F.broadcast(sums), "cell").withColumn("below", F.col("low") + inside)
    total = placed.agg(F.sum("wp").alias("positives"), F.sum("wn").alias("negatives"), F.sum(F.col("wp") * (F.col("below") + F.col("wn") / 2)).alias("u"))
    area = F.col("u") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0.0))
    return total.select("positives", "negatives", area.alias("auc"))


def confusion_cells(df: DataFrame, truth: str, probabilities: dict[str, str], weight: str, clip: float = 1e-15) -> DataFrame:
    """(t, g, n, w, loss, p_<class>): counts, weights, weighted log loss and weighted
    probabilities by true and most probable class; the first class wins ties. Probabilities
    are scaled to sum to one. A table of classes squared, made in one pass."""
    classes = list(probabilities)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in probabilities.values()])
    p = {c: F.col(v) / total for c, v in probabilities.items()}
    every = F.array(*p.values())
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position(every, F.array_max(every)).cast("int"))
    own = F.lit(None).cast("double")
    for c in classes:
        own = F.when(F.col(truth) == c, p[c]).otherwise(own)
    w = F.col(weight).cast("double")
    return df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), best.alias("g")).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(-w * F.log(F.greatest(own, F.lit(clip)))).alias("loss"),
        *[F.sum(w * p[c]).alias(f"p_{c}") for c in classes],
    )


def class_table(cells: DataFrame, size: str, classes: Sequence[str]) -> DataFrame:
    """(class, support, guessed, hits, precision, recall, f1) of every class, by counts or weights."""
    s = F.col(size).cast("double")
    sums = cells.agg(*[F.sum(F.when(test, s).otherwise(0.0)).alias(f"{name}_{k}") for k, c in enumerate(classes) for name, test in (
        ("s", F.col("t") == c), ("g", F.col("g") == c), ("h", (F.col("t") == c) & (F.col("g") == c)))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), *[F.coalesce(F.col(f"{n}_{k}"), F.lit(0.0)).alias(m) for n, m in (("s", "support"), ("g", "guessed"), ("h", "hits"))]) for k, c in enumerate(classes)]))
    out = sums.select(rows.alias("r")).select("r.*")
    return out.withColumns(
        {"precision": _ratio(F.col("hits"), F.col("guessed")), "recall": _ratio(F.col("hits"), F.col("support")), "f1": _ratio(2 * F.col("hits"), F.col("support") + F.col("guessed"))}
    )


def evaluate_classifier(
    df: DataFrame, truth: str, probabilities: dict[str, str], weight: str, positive: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """(metric, value) of held-out rows: accuracy, balanced accuracy and macro F1, each
    unweighted and weighted, and weighted log loss; with `positive`, also the weighted area
    under the curve, Brier score, F1 at the threshold, observed and predicted rate and
    their gap in points, of that class against the rest."""
    classes = list(probabilities)
    cells = confusion_cells(df, truth, probabilities, weight)
    parts = []
    for prefix, size in (("", "n"), ("weighted_", "w")):
        table = class_table(cells, size, classes)
        seen = F.col("support") + F.col("guessed") > 0
        parts.append(table.agg(
            (F.sum("hits") / F.sum("support")).alias(f"{prefix}accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias(f"{prefix}balanced_accuracy"),
            F.avg(F.when(seen, F.col("f1"))).alias(f"{prefix}f1_macro"),
        ))
    parts.append(cells.agg((F.sum("loss") / F.sum("w")).alias("weighted_log_loss")))
    if positive is not None:
        total = reduce(lambda a, b: a + b, [F.col(c) for c in probabilities.values()])
        d = df.where(F.col(truth).isNotNull()).select((F.col(truth) == positive).cast("int").alias("y"), (F.col(probabilities[positive]) / total).alias("p"), F.col(weight).cast("double").alias("w"))
        over, y, w = (F.col("p") >= threshold).cast("int"), F.col("y"), F.col("w")
        # The scaling leaves noise in the last digits, which must not break ties.
        parts.append(weighted_auc(d.withColumn("p", F.round("p", 12)), "y", "p", "w").select(F.col("auc").alias("weighted_roc_auc")))
        rates = d.agg(
            (F.sum(w * F.pow(F.col("p") - y, 2)) / F.sum(w)).alias("weighted_brier_score"), _ratio(2 * F.sum(w * y * over), F.sum(w * (y + over))).alias("weighted_f1"),
            (F.sum(w * y) / F.sum(w)).alias("observed_rate"), (F.sum(w * F.col("p")) / F.sum(w)).alias("predicted_rate"),
        )
        parts.append(rates.withColumn("calibration_gap_pp", (F.col("predicted_rate") - F.col("observed_rate")) * 100))
    wide = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns]))
    return wide.select(rows.alias("r")).select("r.*")


def class_shares(df: DataFrame, truth: str, probabilities: dict[str, str], weight: str) -> DataFrame:
    """(class, observed, hard, probabilistic, difference_pp): weighted shares of the true
    classes, of the most probable ones and of the probabilities; the last is the gap in
    points between the probabilistic and the observed share."""
    classes = list(probabilities)
    cells = confusion_cells(df, truth, probabilities, weight)
    table = class_table(cells, "w", classes)
    sums = cells.agg(F.sum("w").alias("_all"), *[F.sum(f"p_{c}").alias(f"p_{c}") for c in classes])
    expected = F.lit(None).cast("double")
    for c in classes:
        expected = F.when(F.col("class") == c, F.col(f"p_{c}")).otherwise(expected)
    out = table.crossJoin(F.broadcast(sums)).select(
        "class", (F.col("support") / F.col("_all")).alias("observed"), (F.col("guessed") / F.col("_all")).alias("hard"), (expected / F.col("_all")).alias("probabilistic")
    )
    return out.withColumn("difference_pp", (F.col("probabilistic") - F.col("observed")) * 100)


def weighted_quantiles(df: DataFrame, value: str, weight: str, shares: Sequence[float], cells: int = CELLS) -> DataFrame:
    """(share, value): the least value at which the running weight reaches that share of
    all; values are summed by equal cells of their range, then by value in the one cell
    that holds the share, so no task orders all rows."""
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    ends = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("all"))
    d = d.crossJoin(F.broadcast(ends))
    cell = F.coalesce(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * cells), F.lit(0))
    d = d.withColumn("cell", F.least(cell, F.lit(cells - 1)))
    sums = d.groupBy("cell").agg(F.sum("w").alias("c"))
    run = Window.orderBy("cell")  # a row for each cell
    sums = sums.withColumn("to", F.sum("c").over(run)).withColumn("from", F.col("to") - F.col("c"))
    asked = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    near = asked.crossJoin(F.broadcast(ends)).join(F.broadcast(sums), F.col("to") >= F.col("share") * F.col("all") * (1 - 1e-12))
    near = near.groupBy("share").agg(F.min_by(F.struct("cell", "from"), "cell").alias("x")).select("share", "x.cell", "x.from")
    within = d.join(F.broadcast(near), "cell").withColumn("at", F.col("from") + F.sum("w").over(Window.partitionBy("share", "cell").orderBy("v")))
    return within.where(F.col("at") >= F.col("share") * F.col("all") * (1 - 1e-12)).groupBy("share").agg(F.min("v").alias("value"))
