"""Validated joins, and joins of persons and diaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import TASK_ROWS, stage


def enrich_from_parent(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many-to-one left join; a parent key that repeats is an error."""
    twice = parent.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"parent key repeats: {twice[0]}")
    return child.join(parent, list(keys), "left")


def attach_weight(df: DataFrame, weights: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Join a weight to every row; keys must be unique, weights finite and positive, and
    every row matched."""
    out = enrich_from_parent(df, weights.select(key, F.col(weight).cast("double").alias(weight)), [key])
    bad = out.where(~F.coalesce((F.col(weight) > 0) & (F.col(weight) < float("inf")), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"no usable weight: {bad[0]}")
    return out


def household_head(persons: DataFrame, hh: str, person: str, is_head: str, age: str) -> DataFrame:
    """(hh, head, source): the reported head (first), else the oldest member."""
    w = Window.partitionBy(hh).orderBy(F.desc(F.coalesce(F.col(is_head), F.lit(False))), F.desc(age), person)
    first = persons.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select(hh, F.col(person).alias("head"), F.when(F.col(is_head), "reported").otherwise("oldest").alias("source"))


def other_members(persons: DataFrame, hh: str, value: str) -> DataFrame:
    """Sum and maximum of value over the other members, by household totals and the two
    largest values instead of a self-join."""
    top = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 2)
    each = persons.groupBy(F.col(hh).alias("_hh")).agg(top.alias("_top"), F.sum(value).alias("_sum"))
    others = F.when(F.col(value).eqNullSafe(F.col("_top")[0]), F.try_element_at("_top", F.lit(2))).otherwise(F.col("_top")[0])
    return (
        persons.join(each, F.col(hh).eqNullSafe(F.col("_hh")), "left")
        .withColumn("others_sum", F.coalesce("_sum", F.lit(0)) - F.coalesce(F.col(value), F.lit(0)))
        .withColumn("others_max", others)
        .drop("_hh", "_top", "_sum")
    )


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(orphans): child rows whose key the parent lacks."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("orphans"))


def key_changes(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or changed rows."""
    a = before.select(key, F.struct(*columns).alias("_a"))
    b = after.select(key, F.struct(*columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def repeated_diary_pairs(chains: DataFrame, group: Sequence[str], hh: str, person: str, trip: str, start: str, fields: Sequence[str], max_offset: int = 10, min_trips: int = 2) -> DataFrame:
    """Pairs of persons of different households with the same ordered diary and every
    start within max_offset minutes: (group, person_a, person_b, max_offset).

    Diaries are reduced to the hash of their signature before the self-join, and meet
    only within their group (area and date) and the band of their first start, so that a
    common diary is dealt to as many keys as its starts spread over.
    """
    items = F.array_sort(F.collect_list(F.struct(trip, F.col(start).alias("_s"), *fields)))
    one = chains.groupBy(*group, hh, person).agg(items.alias("_t")).where(F.size("_t") >= min_trips)
    one = one.select(
        *group, F.col(hh).alias("h"), F.col(person).alias("p"), F.transform("_t", lambda t: t["_s"]).alias("s"),
        F.xxhash64(F.to_json(F.transform("_t", lambda t: F.struct(*[t[f].alias(f) for f in fields])))).alias("sig"),
        F.sha2(F.to_json(F.transform("_t", lambda t: F.struct(*[t[f].alias(f) for f in fields]))), 256).alias("full"),
    )
    one = one.where(F.forall("s", lambda x: x.isNotNull())).withColumn("band", F.floor(F.get("s", F.lit(0)) / (max_offset + 1)))
    keys = [*group, "sig", "full", "band"]
    a = one.withColumnsRenamed({"h": "h_a", "p": "person_a", "s": "s_a"})
    near = one.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    b = near.withColumnsRenamed({"h": "h_b", "p": "person_b", "s": "s_b"})
    offset = F.array_max(F.zip_with("s_a", "s_b", lambda x, y: F.abs(x - y)))
    return (
        a.join(b, keys).where(F.col("h_a") < F.col("h_b")).withColumn("max_offset", offset)
        .where(F.col("max_offset") <= max_offset).select(*group, "person_a", "person_b", "max_offset")
    )


def fallback_join(units: DataFrame, stats: DataFrame, key: str, parents: DataFrame, parent_key: str, value: str, allowed: str) -> DataFrame:
    """A unit's own statistic, else its parent's where `allowed` holds, else NULL."""
    own = stats.select(key, F.col(value).alias("_own"))
    above = parents.select(parent_key, F.col(value).alias("_above"))
    out = units.join(own, key, "left").join(above, parent_key, "left")
    return out.withColumn(value, F.coalesce("_own", F.when(F.expr(allowed), F.col("_above")))).drop("_own", "_above")


def diaries_of(chains: DataFrame, group: Sequence[str], hh: str, person: str, trip: str, start: str, fields: Sequence[str], min_trips: int = 2) -> DataFrame:
    """(group, h, p, s, sig), written once: each person's starts in order and the digest of the
    ordered diary. Persons of the same group, sig and s are one class. Diaries of fewer trips,
    with a start missing, or without a group or household have no twin and are left out."""
    items = F.array_sort(F.collect_list(F.struct(trip, F.col(start).alias("_s"), *fields)))
    one = chains.groupBy(*group, F.col(hh).alias("h"), F.col(person).alias("p")).agg(items.alias("_t")).where(F.size("_t") >= min_trips)
    one = one.select(
        *group, "h", "p", F.transform("_t", lambda t: t["_s"].cast("long")).alias("s"),
        F.unhex(F.sha2(F.to_json(F.transform("_t", lambda t: F.struct(*[t[f].alias(f) for f in fields]))), 256)).alias("sig"),
    )
    return stage(one.where(F.forall("s", lambda x: x.isNotNull())).dropna(subset=[*group, "h"]))


def starts_apart(s: str, t: str) -> Column:
    """The largest difference of two lists of starts."""
    return F.array_max(F.zip_with(s, t, lambda x, y: F.abs(x - y)))


def cells(radius: int, near: bool = False) -> list[Column]:
    """Cells of the first start in which lists s that are no more than radius apart meet: the
    own one, or with near those beside it too."""
    own = F.floor(F.element_at("s", 1) / (radius + 1))
    return [own + k for k in ((-1, 0, 1) if near else (0,))]


def meet_in_cells(a: DataFrame, b: DataFrame, by: Sequence[str], radius: int) -> DataFrame:
    """Rows of a (with starts s) beside those of b (starts t) with equal by whose starts are
    within radius of each other, and their gap. a is written to the cells beside its own too;
    both go to as many tasks as these rows need, so that no task grows with the tables. a is
    counted, so it should be a stored table or cheap to make again."""
    touched = cells(radius, True)
    tasks = max(1, -(-len(touched) * a.count() // TASK_ROWS))
    here = a.withColumn("cell", F.explode(F.array(*touched)))
    there = b.withColumn("s", F.col("t")).withColumn("cell", cells(radius)[0]).drop("s")
    both = here.repartition(tasks, *by, "cell").join(there.repartition(tasks, *by, "cell"), [*by, "cell"])
    return both.withColumn("gap", starts_apart("s", "t")).where(F.col("gap") <= radius)


def diary_twins(chains: DataFrame, group: Sequence[str], hh: str, person: str, trip: str, start: str, fields: Sequence[str], max_offset: int = 10, min_trips: int = 2) -> DataFrame:
    """(group, person, twins): for each person with any, how many persons of other households
    have the same ordered diary within max_offset minutes.

    No pairs of persons are made: persons of equal diary and starts are one class, and a
    person's twins are the members of near classes less those of the own household, which are
    counted within the household. A common diary costs as many comparisons as it has pairs of
    distinct starts; what moves between tasks are classes and sums, never pairs.
    """
    one = diaries_of(chains, group, hh, person, trip, start, fields, min_trips)
    key = [*group, "sig"]
    per = stage(one.groupBy(*key, "s", "h").agg(F.count("*").alias("m")))

    def within(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        there = counts.select(*by, F.col("s").alias("t"), "m")
        return meet_in_cells(counts.select(*by, "s"), there, by, max_offset).groupBy(*by, "s").agg(F.sum("m").alias(name))

    whole = within(stage(per.groupBy(*key, "s").agg(F.sum("m").alias("m"))), key, "whole")
    own = within(per, [*key, "h"], "own")
    twins = own.join(whole, [*key, "s"]).select(*key, "s", "h", (F.col("whole") - F.col("own")).alias("twins")).where("twins > 0")
    return one.join(twins, [*key, "s", "h"]).select(*group, F.col("p").alias(person), "twins")


def nearest_twins(diaries: DataFrame, group: Sequence[str], traits: Sequence[str], max_offset: int) -> DataFrame:
    """(group, p, b): b is the least (max_offset, differs, twin) over the persons of other
    households with the same diary and starts within max_offset; differs tells whether one of
    the traits (null is a value) does. diaries: the stored result of diaries_of, with traits.

    No pairs of persons are made: of a class (group, sig, s) and traits, the least persons of
    two households stand for all, since one of them is of another household than any asker.
    Askers are households, not persons. The own class is tried first; those who find nobody
    search classes within a sixteenth, a quarter and the whole of max_offset.
    """
    key = [*group, "sig"]
    asks = stage(diaries.groupBy(*key, "s", *traits, "h").agg(F.min("p").alias("p")))
    first = Window.partitionBy(*key, "s", *traits).orderBy("p", "h")
    tops = asks.withColumn("_n", F.row_number().over(first)).where("_n <= 2")
    tops = stage(tops.select(*key, F.col("s").alias("t"), *[F.col(c).alias(f"{c}_t") for c in traits], F.col("h").alias("h_t"), F.col("p").alias("twin")))
    asker = [*key, "s", "h", *traits]
    asks = asks.select(*asker)
    same = F.lit(True)
    for c in traits:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_t"))
    best = F.min(F.struct(F.col("gap").alias("max_offset"), (~same).alias("differs"), "twin")).alias("b")
    own = asks.join(tops.withColumnRenamed("t", "s"), [*key, "s"]).where("h <> h_t")
    found = [stage(own.withColumn("gap", F.lit(0).cast("long")).groupBy(*asker).agg(best))]
    for radius in sorted({max_offset // 16, max_offset // 4, max_offset} - {0}):
        asks = stage(asks.alias("a").join(found[-1].alias("f"), [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in asker], "left_anti"))
        if asks.isEmpty():
            break
        found.append(stage(meet_in_cells(asks, tops, key, radius).where("h <> h_t").groupBy(*asker).agg(best)))
    found = reduce(DataFrame.union, found)
    same_asker = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in asker]
    met = diaries.alias("d").join(found.alias("f"), same_asker).select(*[F.col(f"d.{c}").alias(c) for c in (*group, "p")], "f.b")
    return met.groupBy(*group, "p").agg(F.min("b").alias("b"))
