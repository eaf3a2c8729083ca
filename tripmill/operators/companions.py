"""Trips that members of a household make together, and the twins of repeated diaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import over
from .joins import nearest_twins

_TRIP = ("origin", "dest", "motive")


def minutes_apart(a: Column, b: Column) -> Column:
    """Minutes between two times of day on a 24-hour clock."""
    d = F.abs(a - b) % 1440
    return F.least(d, 1440 - d)


def _sides(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    side = lambda s: df.select(*keys, *[c.alias(f"{n}_{s}") for n, c in columns.items()])
    return side("a"), side("b")


def companion_links(df: DataFrame, household: Sequence[str], person: str = "person", escort: Sequence[str] = (), tolerance: int = 20) -> DataFrame:
    """(household, person_a, trip_a, person_b, trip_b, via): trips of two members with the
    same zones and motive, whose trips before (else after) them match too, are no escorts,
    start within tolerance minutes and overlap. A link is void if one of its trips is the
    same entry (zones, motive, time) as another trip of the other member.

    household holds the household and day: pairs meet only within them and on equal zones
    and motives. A null in any of these matches nothing.
    """
    keys = [*household, *_TRIP]
    w = over([*household, person])
    found = None
    for rank, (via, neighbour) in enumerate((("previous", F.lag), ("next", F.lead))):
        near = df.withColumns({f"_{c}": neighbour(c).over(w) for c in (*_TRIP, "start", "minutes")})
        both = [*keys, *[f"_{c}" for c in _TRIP]]
        a, b = _sides(near, both, {"person": F.col(person), "trip": F.col("trip"), "at": F.col("start"), "s": F.col("_start"), "e": F.col("_start") + F.col("_minutes")})
        part = a.join(b, both).where(
            (F.col("person_a") < F.col("person_b")) & (minutes_apart(F.col("s_a"), F.col("s_b")) <= tolerance)
            & (F.col("s_a") <= F.col("e_b")) & (F.col("s_b") <= F.col("e_a"))
        )
        if escort:
            part = part.where(~F.col("_motive").isin(*escort))
        part = part.select(*keys, "person_a", "trip_a", "person_b", "trip_b", "at_a", "at_b", F.lit(rank).alias("rank"), F.lit(via).alias("via"))
        found = part if found is None else found.unionByName(part)
    pair = [*household, "person_a", "trip_a", "person_b", "trip_b"]
    links = found.groupBy(*keys, *pair[len(household) :], "at_a", "at_b").agg(F.min_by("via", "rank").alias("via"))

    # the other member's trips are looked up from the link, so that no pairs but these are made
    entries = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(person).alias("_who"), F.col("trip").alias("_other"), F.col("start").alias("_at"))
    for own, theirs in ("ab", "ba"):
        same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col(f"person_{theirs}") == F.col("_who"))
        again = (F.col("_other") != F.col(f"trip_{theirs}")) & (minutes_apart(F.col(f"at_{own}"), F.col("_at")) <= tolerance)
        links = links.join(entries, same & again, "left_anti")
    return links.select(*pair, "via")


def companion_checks(links: DataFrame, trips: DataFrame, household: Sequence[str], person: str = "person", tolerance: int = 20) -> DataFrame:
    """links with start_a, start_b and what their clock shows: same_entry, half_day (twelve
    hours apart) or apart; null if a start is missing."""
    out = links
    for s in "ab":
        one = trips.select(*household, F.col(person).alias(f"person_{s}"), F.col("trip").alias(f"trip_{s}"), F.col("start").alias(f"start_{s}"))
        out = out.join(one, [*household, f"person_{s}", f"trip_{s}"], "left")
    gap = minutes_apart(F.col("start_a"), F.col("start_b"))
    status = F.when(gap <= tolerance, "same_entry").when(720 - gap <= tolerance, "half_day").when(gap.isNotNull(), "apart")
    return out.withColumn("status", status)


def closest_twin(diaries: DataFrame, persons: DataFrame, group: Sequence[str], person: str, demographics: Sequence[str], max_offset: int, cuts: Sequence[tuple[int, str]], top: str) -> DataFrame:
    """(group, person, twin, max_offset, same, offset_class): for each person of a repeated
    diary the twin with the least offset; ties go to equal demographics, then to the
    smallest id. diaries is what joins.diaries_of returns; persons (person and demographics)
    has a person once. No pairs are made (joins.nearest_twins)."""
    traits = persons.select(F.col(person).alias("p"), *demographics)
    best = nearest_twins(diaries.join(traits, "p", "left"), group, demographics, max_offset)
    label = F.lit(top)
    for bound, name in reversed(cuts):
        label = F.when(F.col("max_offset") <= bound, name).otherwise(label)
    return best.select(*group, F.col("p").alias(person), "b.twin", "b.max_offset", (~F.col("b.differs")).alias("same")).withColumn("offset_class", label)
