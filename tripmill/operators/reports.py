"""Tables that compare: shares, weights, benchmarks, assignments, snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import spread

from .stats import medians


def flag_repeated_diaries(persons: DataFrame, pairs: DataFrame, keys: Sequence[str], sides: Sequence[Sequence[str]]) -> DataFrame:
    """persons plus repeated_diary: whether any pair holds the person on either side."""
    named = [pairs.select(*[F.col(c).alias(k) for c, k in zip(side, keys)]) for side in sides]
    marked = reduce(DataFrame.union, named).distinct().withColumn("repeated_diary", F.lit(True))
    return persons.join(marked, list(keys), "left").na.fill(False, ["repeated_diary"])


def weighted_mix(df: DataFrame, key: str, size: str, sizes: Sequence, sector: str, sectors: Sequence[str], weight: str) -> DataFrame:
    """Per key: log1p of the units, and the weighted share of each size class and sector (the
    first two characters of its code)."""
    share = lambda test: F.sum(F.when(test, F.col(weight)).otherwise(0)) / F.sum(weight)
    parts = {f"size_{s}": F.col(size) == s for s in sizes} | {f"sector_{s}": F.substring(sector, 1, 2) == s for s in sectors}
    return df.groupBy(key).agg(F.log1p(F.count("*").cast("double")).alias("log_units"), *[share(t).alias(n) for n, t in parts.items()])


def weight_consistency(child: DataFrame, parent: DataFrame, key: str, child_weight: str, parent_weight: str, group: str) -> DataFrame:
    """Per group of parents: parents, those whose children differ in weight, the median ratio
    of a child's weight to its parent's, and both sums over children."""
    joined = spread(child.select(key, child_weight), key).join(parent.select(key, parent_weight, group), key)
    facts = joined.groupBy(group, key).agg(
        (F.coalesce(F.min(child_weight) < F.max(child_weight), F.lit(False))).cast("long").alias("varies"), F.sum(child_weight).alias("_c"), F.sum(parent_weight).alias("_p")
    )
    out = facts.groupBy(group).agg(
        F.count("*").alias("parents"), F.coalesce(F.sum("varies"), F.lit(0)).alias("varying"), F.sum("_c").cast("double").alias("child_sum"), F.sum("_p").cast("double").alias("parent_sum")
    )
    ratio = (F.col(child_weight) / F.col(parent_weight)).cast("double")
    middle = medians(joined.select(group, ratio.alias("_ratio")), [group], "_ratio").withColumnRenamed("median", "ratio")
    return out.join(middle, group, "left").select(group, "parents", "varying", "ratio", "child_sum", "parent_sum").where(F.col(group).isNotNull())


def compare_profiles(df: DataFrame, columns: Sequence[str], unknown: Column, weight: str) -> DataFrame:
    """(feature, level, known, unknown, difference): weighted shares of the levels among rows
    with and without an answer, and the difference in percentage points."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns]))
    long = df.select(told.alias("t"), unknown.alias("u"), F.col(weight).alias("w")).select("t.*", "u", "w")
    sums = long.groupBy("feature", "level").agg(*[F.coalesce(F.sum(F.when(F.col("u") == v, F.col("w"))), F.lit(0)).alias(n) for n, v in (("k", False), ("m", True))])
    whole = Window.partitionBy("feature")
    share = lambda c: F.col(c) / F.sum(c).over(whole)
    out = sums.withColumns({"known": share("k"), "unknown": share("m")}).drop("k", "m")
    return out.withColumn("difference", 100 * (F.col("unknown") - F.col("known")))


def calibration_metrics(df: DataFrame, p: str, y: str, weight: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over bins of equal width, and the gap of the mean
    probability from the observed share in percentage points. calibration_line() of the
    models gives slope and intercept."""
    cell = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    sums = df.groupBy(cell.alias("cell")).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(p)).alias("wp"), F.sum(F.col(weight) * F.col(y)).alias("wy"))
    whole = F.sum("w")
    return sums.agg((F.sum(F.abs(F.col("wp") - F.col("wy"))) / whole).alias("ece"), (100 * (F.sum("wp") - F.sum("wy")) / whole).alias("gap_pp"))


def compare_to_reference(df: DataFrame, area: str, level: str, weight: str, reference: DataFrame, count: str) -> DataFrame:
    """(level, share, reference_share): weighted shares over the areas that both cover."""
    both = df.select(area).distinct().join(reference.select(area).distinct(), area)
    sums = lambda d, w, n: d.join(both, area, "left_semi").groupBy(level).agg(F.sum(w).alias(n))
    out = sums(df, weight, "_a").join(sums(reference, count, "_b"), level, "full").na.fill(0, ["_a", "_b"])
    whole = Window.partitionBy()
    return out.select(level, (F.col("_a") / F.sum("_a").over(whole)).alias("share"), (F.col("_b") / F.sum("_b").over(whole)).alias("reference_share"))


def benchmark_rates(df: DataFrame, group: str, p: str, weight: str, benchmark: DataFrame, rate: str, size: str) -> DataFrame:
    """Per group: the expected rate, its share of the weight, the benchmark's rate and share,
    and the two parts of the gap of the totals: model (rates differ) and composition
    (shares differ)."""
    own = df.groupBy(group).agg(F.sum(F.col(weight) * F.col(p)).alias("_wp"), F.sum(weight).alias("_w"))
    out = own.join(benchmark.select(group, F.col(rate).alias("benchmark"), F.col(size).alias("_s")), group)
    whole = Window.partitionBy()
    out = out.withColumns({"expected": F.col("_wp") / F.col("_w"), "share": F.col("_w") / F.sum("_w").over(whole), "benchmark_share": F.col("_s") / F.sum("_s").over(whole)})
    parts = {"model": F.col("share") * (F.col("expected") - F.col("benchmark")), "composition": (F.col("share") - F.col("benchmark_share")) * F.col("benchmark")}
    return out.withColumns(parts).drop("_wp", "_w", "_s")


def chain_headline(rates: DataFrame) -> DataFrame:
    """One row of benchmark_rates(): both totals and the parts of their gap."""
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    return rates.agg(dot("share", "expected").alias("expected"), dot("benchmark_share", "benchmark").alias("benchmark"), F.sum("model").alias("model"), F.sum("composition").alias("composition"))


def check_assignment(found: DataFrame, wanted: DataFrame, key: str, zone: str) -> DataFrame:
    """(key, found, wanted, status): units whose zones differ, or that one side lacks."""
    both = found.select(key, F.col(zone).alias("found")).join(wanted.select(key, F.col(zone).alias("wanted")), key, "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("found") != F.col("wanted"), "differs")
    return both.withColumn("status", status).where("status IS NOT NULL")


def check_zone_ids(df: DataFrame, column: str, pattern: str, wanted: DataFrame) -> DataFrame:
    """(check, rows): ids of another form, repeated ids, wanted ids that are missing."""
    ids = df.groupBy(column).agg(F.count("*").alias("n"))
    parts = {
        "format": ids.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))), "repeated": ids.where("n > 1"),
        "missing": wanted.select(column).distinct().join(ids, column, "left_anti"),
    }
    return reduce(DataFrame.union, [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("check"), "rows") for n, d in parts.items()])


def zone_summary(units: DataFrame, zone: str, locality: str, population: str, sample: DataFrame) -> DataFrame:
    """Per zone: units, localities, population, and the rows of the sample (zero if none)."""
    per = units.groupBy(zone).agg(F.count("*").alias("units"), F.count_distinct(locality).alias("localities"), F.sum(population).alias("population"))
    return per.join(sample.groupBy(zone).agg(F.count("*").alias("sampled")), zone, "left").na.fill(0, ["sampled"])


def split_codes(df: DataFrame, code: str, zone: str) -> DataFrame:
    """(code, zones): codes that lie in several zones, for the error that names them."""
    return df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count_distinct(zone).alias("zones")).where("zones > 1")


def chain_rows(shipped: DataFrame, cleaned: DataFrame, keys: Sequence[str], fields: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """(keys, field, before, after, codes, dropped): each field of the shipped rows beside
    its cleaned value; a row that cleaning dropped has none."""
    after = cleaned.select(*keys, *[F.col(c).cast("string").alias(f"_{c}") for c in fields], *codes, F.lit(False).alias("dropped"))
    both = shipped.select(*keys, *fields).join(after, list(keys), "left").na.fill(True, ["dropped"])
    told = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.col(f"_{c}").alias("after")) for c in fields])
    return both.select(*keys, F.inline(told), *codes, "dropped")


def pending_persons(df: DataFrame, person: Sequence[str], issues: str, codes: Sequence[str] = ()) -> DataFrame:
    """(person, codes): persons with any of the codes (any at all if none is given) among the
    ';'-joined issues of their rows, sorted."""
    one = df.select(*person, F.explode(F.split(issues, ";")).alias("_c")).where("_c <> ''")
    one = one.where(F.col("_c").isin(*codes)) if codes else one
    return one.groupBy(*person).agg(F.array_join(F.array_sort(F.collect_set("_c")), ";").alias("codes"))


def snapshot_changes(before: DataFrame, after: DataFrame, person: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(person, status): persons whose rows of fields differ between snapshots, or whom one
    of them lacks. Rows are added up by hash, so a person's rows need no order."""
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in fields])
    halves = [F.sum(F.conv(F.substring(F.md5(row), k, 12), 16, 10).cast("decimal(38,0)")) for k in (1, 13)]
    side = lambda d, n: d.groupBy(*person).agg(F.struct(F.count("*"), *halves).alias(n))
    both = side(before, "a").join(side(after, "b"), list(person), "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*person, status.alias("status")).where("status IS NOT NULL")
