"""The model tables and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_households(households: DataFrame, members: DataFrame, hh: str, reported: str, vehicles: Sequence[str]) -> DataFrame:
    """(hh, size, vehicles): the larger of reported and listed size; vehicles added up."""
    listed = members.groupBy(hh).agg(F.count("*").alias("_listed"))
    out = households.join(listed, hh, "left")
    total = sum((F.coalesce(F.col(v), F.lit(0)) for v in vehicles), F.lit(0))
    return out.select(hh, F.greatest(F.col(reported), F.coalesce("_listed", F.lit(0))).cast("long").alias("size"), total.cast("long").alias("vehicles"))


def build_people(persons: DataFrame, trips: DataFrame, keys: Sequence[str], answer: str, drawn: str, default: str, work: Sequence[str], motive: str = "motive", dest: str = "dest", order: str = "trip") -> DataFrame:
    """keys, employment (answer, else draw, else default) and first work zone."""
    first = trips.where(F.col(motive).isin(*work)).groupBy(*keys).agg(F.min_by(dest, order).alias("work_zone"))
    return persons.join(first, list(keys), "left").select(*keys, F.coalesce(answer, drawn, F.lit(default)).alias("employment"), "work_zone")


def validate_table(df: DataFrame, keys: Sequence[str], not_null: Sequence[str], ranges: dict[str, tuple[float, float]], domains: dict[str, Sequence]) -> DataFrame:
    """(problem, rows): one row for each check that fails, by one aggregate over the rows
    and one over the keys."""
    checks = {f"null:{c}": F.col(c).isNull() for c in not_null}
    checks |= {f"range:{c}": (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in ranges.items()}
    checks |= {f"domain:{c}": ~F.col(c).isin(*values) for c, values in domains.items()}
    wide = df.agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in checks.items()])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("rows")) for n in checks])))
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
    return rows.unionByName(twice.select(F.lit("duplicate_key").alias("problem"), "rows")).where("rows > 0")


def table_invariants(trips: DataFrame, keys: Sequence[str], order: str, purpose: str, home_code: str = "H") -> DataFrame:
    """(home_to_home, gaps): trips from home to home, and chains not numbered 1..n."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = trips.withColumn("_hh", (F.col(purpose) == home_code) & (F.coalesce(F.lag(purpose).over(w), F.lit(home_code)) == home_code))
    chains = t.groupBy(*keys).agg(F.count(F.when(F.col("_hh"), 1)).alias("h"), F.max(order).alias("hi"), F.min(order).alias("lo"), F.count_distinct(order).alias("k"), F.count("*").alias("n"))
    ok = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("k") == F.col("n"))
    return chains.agg(F.sum("h").alias("home_to_home"), F.count(F.when(~ok, 1)).alias("gaps"))


def household_expansion(df: DataFrame, households: DataFrame, hh: str, weight: str, own: bool) -> DataFrame:
    """expansion: the row's own weight, or its household's on every level."""
    if own:
        return df.withColumn("expansion", F.col(weight).cast("double"))
    return df.join(households.select(hh, F.col(weight).cast("double").alias("expansion")), hh, "left")
