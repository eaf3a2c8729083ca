"""Survey statistics: weighted shares, variances, quantiles, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_distribution(df: DataFrame, column: str, weight: str) -> DataFrame:
    """(value, weight, share), NULL answers a group of their own."""
    sums = df.groupBy(F.col(column).alias("value")).agg(F.sum(weight).alias("weight"))
    total = sums.agg(F.sum("weight").alias("_all"))
    return sums.crossJoin(F.broadcast(total)).select("value", "weight", (F.col("weight") / F.col("_all")).alias("share"))


def probabilistic_distribution(df: DataFrame, probabilities: Sequence[str], weight: str) -> DataFrame:
    """(class, weight, share) of the columns of class probabilities."""
    wide = df.agg(*[F.sum(F.col(weight) * F.col(p)).alias(p) for p in probabilities])
    total = reduce(Column.__add__, [F.col(p) for p in probabilities])
    return wide.withColumn("_all", total).unpivot(["_all"], list(probabilities), "class", "weight").select("class", "weight", (F.col("weight") / F.col("_all")).alias("share"))


def modal_value_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most common answer of each key: by count, then value; NULLs do not count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n"))


def first_destination(df: DataFrame, keys: Sequence[str], trip: str, dest: str, motive: str, motives: Sequence[str]) -> DataFrame:
    """First destination in chain order among trips of the motives."""
    return df.where(F.col(motive).isin(*motives)).groupBy(*keys).agg(F.min_by(dest, trip).alias("first_dest"))


def unit_ratio(df: DataFrame, key: str, num: Sequence[str], den: Sequence[str]) -> DataFrame:
    """Sum of num over sum of den on rows with all parts published; NULL if not positive."""
    whole = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*num, *den]]))
    add = lambda cols: F.sum(reduce(Column.__add__, [F.col(c) for c in cols]))
    sums = whole.groupBy(key).agg(add(num).alias("_n"), add(den).alias("_d"))
    return sums.select(key, F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")).alias("ratio"))


def smoothed_crosstab(df: DataFrame, kind: str, hour: str, add: float = 0.5) -> DataFrame:
    """Hour-of-day shares of each kind, `add` added to all 24 cells."""
    kinds = df.select(kind).where(F.col(kind).isNotNull()).distinct()
    cells = kinds.select(kind, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias(hour))
    n = df.groupBy(kind, F.col(hour).cast("long").alias(hour)).agg(F.count("*").alias("n"))
    filled = cells.join(n, [kind, hour], "left").withColumn("n", F.coalesce("n", F.lit(0)) + add)
    return filled.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(kind))).select(kind, hour, "share")


def block_rates(df: DataFrame, block: Sequence[str], flag: str) -> DataFrame:
    """(blocks, q50, q75, q90, q99): exact quantiles of the share flagged in each block."""
    rates = df.groupBy(*block).agg(F.avg(F.col(flag).cast("double")).alias("rate"))
    qs = {"q50": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99}
    return rates.agg(F.count("*").alias("blocks"), *[F.percentile("rate", F.lit(q)).alias(k) for k, q in qs.items()])


def reliability_table(df: DataFrame, y: str, p: str, weight: str, bins: int = 10) -> DataFrame:
    """Right-closed equal bins on [0, 1], the lowest value included: (bin, n, weight,
    observed, predicted)."""
    at = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("long").alias("bin")
    w = F.col(weight)
    return df.groupBy(at).agg(
        F.count("*").alias("n"), F.sum(w).alias("weight"), (F.sum(w * F.col(y)) / F.sum(w)).alias("observed"),
        (F.sum(w * F.col(p)) / F.sum(w)).alias("predicted"),
    )


def cluster_shares(df: DataFrame, y: str, w: str, cluster: str, by: str) -> DataFrame:
    """(by, share, variance): weighted share and its linearised variance
    n / (n - 1) * sum(z_c^2) / (sum w)^2 over the clusters of a group."""
    per = df.groupBy(by, cluster).agg(F.sum(w).alias("_w"), F.sum(F.col(w) * F.col(y)).alias("_wy"))
    total = per.groupBy(by).agg(F.sum("_w").alias("_W"), F.sum("_wy").alias("_Y"), F.count("*").alias("_n"), F.sum(F.col("_wy") * F.col("_wy")).alias("_yy"), F.sum(F.col("_wy") * F.col("_w")).alias("_wyw"), F.sum(F.col("_w") * F.col("_w")).alias("_ww"))
    share = F.col("_Y") / F.col("_W")
    squares = F.col("_yy") - 2 * F.col("share") * F.col("_wyw") + F.col("share") * F.col("share") * F.col("_ww")
    variance = F.when(F.col("_n") > 1, F.col("_n") / (F.col("_n") - 1) * squares / (F.col("_W") * F.col("_W")))
    return total.withColumn("share", share).select(by, "share", variance.alias("variance"))


def stratified_share(df: DataFrame, y: str, w: str, stratum: str, psu: str) -> DataFrame:
    """(share, se): strata with a single primary unit add nothing."""
    per = df.groupBy(stratum, psu).agg(F.sum(w).alias("_w"), F.sum(F.col(w) * F.col(y)).alias("_wy"))
    total = per.agg(F.sum("_w").alias("_tw"), F.sum("_wy").alias("_ty"))
    z = per.crossJoin(F.broadcast(total)).withColumn("_z", (F.col("_wy") - F.col("_ty") / F.col("_tw") * F.col("_w")) / F.col("_tw"))
    each = z.groupBy(stratum).agg(F.count("*").alias("_n"), F.var_samp("_z").alias("_v"))
    v = each.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") * F.col("_v"))), F.lit(0.0)).alias("_var"))
    return total.crossJoin(v).select((F.col("_ty") / F.col("_tw")).alias("share"), F.sqrt("_var").alias("se"))


def trips_per_person(persons: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(trips, persons, cumulative): persons by trip count, none included."""
    n = trips.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = persons.join(n, list(keys), "left").groupBy(F.coalesce("_n", F.lit(0)).alias("trips")).agg(F.count("*").alias("persons"))
    # one row for each trip count, a bounded result
    running = F.sum("persons").over(Window.orderBy("trips")) / F.sum("persons").over(Window.partitionBy())
    return sizes.withColumn("cumulative", running)


def confusion(df: DataFrame, truth: str, guess: str, weight: str) -> DataFrame:
    """(class, support, precision, recall, f1) of weighted predictions."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.sum(weight).alias("w"))
    ends = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("w").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("g"), F.col("w")).otherwise(0).alias("h")), F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("s"), F.col("w").alias("p"), F.lit(0).cast("long").alias("h")))).alias("e")).select("e.*")
    sums = ends.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    precision, recall = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0), F.when(F.col("support") > 0, F.col("h") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("p") + F.col("support") > 0, 2 * F.col("h") / (F.col("p") + F.col("support"))).otherwise(0.0)
    return sums.select("class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def feature_missingness(df: DataFrame, columns: Sequence[str], unknown: str, weight: str) -> DataFrame:
    """(feature, known_missing, unknown_missing): weighted missing share of either part."""
    w, u = F.col(weight), F.col(unknown)
    part = lambda c, test: F.sum(F.when(test & F.col(c).isNull(), w).otherwise(0)) / F.sum(F.when(test, w).otherwise(0))
    wide = df.agg(*[x for c in columns for x in (part(c, ~u).alias(f"k_{c}"), part(c, u).alias(f"u_{c}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"k_{c}").alias("known_missing"), F.col(f"u_{c}").alias("unknown_missing")) for c in columns]))
    return wide.select(rows.alias("r")).select("r.*")


def medians(df: DataFrame, by: Sequence[str], value: str, cells: int = 1024) -> DataFrame:
    """(by, median): exact medians of groups of any size. Values are counted first; running
    counts over cells of a group's range find the cells of the two middle values, and only
    those are put in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ends = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    d = _beside(counts, ends, by)
    place = F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * cells)
    d = d.withColumn("_cell", F.least(F.coalesce(place, F.lit(0)), F.lit(cells - 1)))
    sums = d.groupBy(*by, "_cell").agg(F.sum("_n").alias("_c"), F.first("_all").alias("_all"))
    run = Window.partitionBy(*by).orderBy("_cell")
    sums = sums.withColumn("_to", F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
    wanted = F.explode(F.array(F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1))
    held = sums.withColumn("_k", wanted).where((F.col("_from") < F.col("_k")) & (F.col("_k") <= F.col("_to")))
    held = held.groupBy(*by, "_cell").agg(F.first("_from").alias("_from"), F.collect_list("_k").alias("_ks"))
    inside = _beside(d.drop("_all"), held, [*by, "_cell"]).where("_ks IS NOT NULL")
    at = F.col("_from") + F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_v"))
    inside = inside.withColumn("_at", at).withColumn("_k", F.explode("_ks")).where((F.col("_at") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_at")))
    return inside.groupBy(*by).agg(F.avg("_v").alias("median"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, low, median, high, nulls) of numeric columns."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.select(told.alias("t")).select("t.*")
    counts = long.groupBy("column", "x").agg(F.count("*").alias("n"))
    facts = counts.groupBy("column").agg(
        F.count("x").alias("distinct"), F.min("x").alias("low"), F.max("x").alias("high"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("nulls")
    )
    return facts.join(medians(long, ["column"], "x"), "column", "left").select("column", "distinct", "low", "median", "high", "nulls")


def _beside(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the other columns of found, one row for each value of keys, nulls included."""
    named = found.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(named, same, "left").drop(*[f"_key_{k}" for k in keys])


def allocate(df: DataFrame, cell: str, value: str, total: str, sampled: str) -> DataFrame:
    """Share each cell's total over its sampled areas in proportion to their own value. The
    sums are aggregated and joined, so that no cell is one task."""
    own = F.when(F.col(sampled), F.col(value)).otherwise(0)
    out = _beside(df, df.groupBy(cell).agg(F.sum(own).alias("_all")), [cell])
    return out.withColumn("allocated", F.when(F.col(sampled), F.col(total) * own / F.col("_all")).otherwise(0.0)).drop("_all")


def rank_calibrate(df: DataFrame, groups: Sequence[str], score: str, tie: str, weight: str, bounds: DataFrame, group_key: str, cells: int = 1000) -> DataFrame:
    """Level of each row: weighted mid-rank by score within its group, placed on the
    reference cumulative distribution; bounds (group_key, cumulative: array), small.

    Ranks are made in two steps: sums of the weights of each cell of a group's range of
    scores, added up in order, and ranks within the cells, so that a group is dealt over
    as many tasks as it has cells."""
    range_ = df.groupBy(*groups).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum(weight).alias("_all"))
    d = _beside(df, range_, groups)
    place = (F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    d = d.withColumn("_cell", F.coalesce(F.floor(place * cells), F.when(F.col(score).isNull(), F.lit(-1)).otherwise(F.lit(0))).cast("long"))
    sums = d.groupBy(*groups, "_cell").agg(F.sum(weight).alias("_w"))
    below = F.coalesce(F.sum("_w").over(Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = _beside(d, sums.select(*groups, "_cell", below.alias("_below")), [*groups, "_cell"])
    within = Window.partitionBy(*groups, "_cell").orderBy(score, tie).rowsBetween(Window.unboundedPreceding, 0)
    rank = (F.col("_below") + F.sum(weight).over(within) - F.col(weight) / 2) / F.col("_all")
    placed = d.withColumn("_rank", rank).join(F.broadcast(bounds), group_key, "left")
    level = F.size(F.filter("cumulative", lambda b: b <= F.col("_rank")))
    out = placed.withColumn("level", F.when(F.col("cumulative").isNotNull(), level).cast("long"))
    return out.drop("_rank", "cumulative", "_lo", "_hi", "_all", "_cell", "_below")
