"""Rules for first trips and for returns that do not reach home."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import over


def age_recode(df: DataFrame, daycare: str, escort: str, limit: int = 12, age: str = "age", motive: str = "motive") -> DataFrame:
    """Someone of the limit age or older who goes to daycare escorts a child there."""
    return df.withColumn(motive, F.when((F.col(motive) == daycare) & (F.col(age) >= limit), escort).otherwise(F.col(motive)))


def next_morning_returns(df: DataFrame, keys: Sequence[str], back: str, work: Sequence[str], evening: int = 1080) -> DataFrame:
    """`next_morning`: a last return from the workplace that the trip before reached in the
    evening, in a chain that begins with a return from that same place."""
    w = over(keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hit = (
        F.lead("trip").over(w).isNull() & (F.col("motive") == back) & F.lag("motive").over(w).isin(*work) & (F.lag("start").over(w) >= evening)
        & (F.lag("dest").over(w) == F.col("origin")) & (F.first("motive").over(whole) == back) & (F.first("origin").over(whole) == F.col("origin"))
    )
    return df.withColumn("next_morning", F.coalesce(hit, F.lit(False)))


def short_returns(df: DataFrame, keys: Sequence[str], back: str, other: str) -> DataFrame:
    """A return that ends away: the last trip, to a zone that no other trip of the chain
    touches, goes home; any other becomes an activity."""
    whole = Window.partitionBy(*keys)
    away = (F.col("motive") == back) & (F.col("dest") != F.col("home"))
    from_there = F.size(F.filter(F.collect_list("origin").over(whole), lambda z: z == F.col("dest"))) - (F.col("origin") == F.col("dest")).cast("int")
    to_there = F.count("*").over(Window.partitionBy(*keys, "dest")) - 1
    alone = F.lead("trip").over(over(keys)).isNull() & (from_there == 0) & (to_there == 0)
    out = df.withColumns({"_away": F.coalesce(away, F.lit(False)), "_alone": F.coalesce(alone, F.lit(False))})
    fixed = {
        "dest": F.when(F.col("_away") & F.col("_alone"), F.col("home")).otherwise(F.col("dest")),
        "motive": F.when(F.col("_away") & ~F.col("_alone"), other).otherwise(F.col("motive")),
    }
    return out.withColumns(fixed).drop("_away", "_alone")


def first_origins_home(df: DataFrame, keys: Sequence[str], back: str, answer: str, home_answer: str, origin_type: str, dest_type: str, night: Sequence[str]) -> DataFrame:
    """A first activity from elsewhere starts at home if its origin repeats the destination,
    its answer says home, or its place type repeats the destination's (but for places where
    people spend the night). `rule` names which: copied_origin, answer or copied_type."""
    first = F.lag("trip").over(over(keys)).isNull() & ~F.col("motive").eqNullSafe(F.lit(back)) & (F.col("origin") != F.col("home"))
    rule = (
        F.when(F.col("origin") == F.col("dest"), "copied_origin").when(F.col(answer) == home_answer, "answer")
        .when((F.col(origin_type) == F.col(dest_type)) & ~F.col(origin_type).isin(*night), "copied_type")
    )
    out = df.withColumn("rule", F.when(F.coalesce(first, F.lit(False)), rule))
    return out.withColumn("origin", F.when(F.col("rule").isNotNull(), F.col("home")).otherwise(F.col("origin")))


def _usual(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, v (most common value, ties to the smallest), n (its rows), t (all rows)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "v"))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("t")).select(*keys, "b.v", (-F.col("b.n")).alias("n"), "t")


def first_return_answers(
    df: DataFrame, person: str, hh: str, occupation: str, target: Column, place_type: str, other: str, least: int = 5, share: float = 0.6
) -> DataFrame:
    """`start_type` of the target rows: the place type that the person's trips to the row's
    origin have most often, else the household's, else that of the occupation's trips there
    if at least `least` trips and a `share` of them agree, else other."""
    seen = df.where(~target).withColumn("_zone", F.col("dest"))
    out = df.withColumn("_zone", F.col("origin"))
    names = []
    for name, key in (("own", person), ("hh", hh), ("job", occupation)):
        votes = _usual(seen, [key, "_zone"], place_type)
        if name == "job":
            votes = votes.where((F.col("t") >= least) & (F.col("n") >= share * F.col("t")))
        out = out.join(votes.select(key, "_zone", F.col("v").alias(f"_{name}")), [key, "_zone"], "left")
        names.append(f"_{name}")
    return out.withColumn("start_type", F.when(target, F.coalesce(*names, F.lit(other)))).drop("_zone", *names)
