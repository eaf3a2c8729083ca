"""Population targets by area and zone, and the checks of a set of constraints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Target:
    """A target: an SQL expression over the area's columns, or the sum of earlier targets;
    then times a correction column, and grown by a rate column, by the rate of its parts
    (`grow_with`, earlier targets), or to the total of its group (`grow_within`: group and
    column of the total); last, at most `most` times the column `of`."""

    name: str
    expr: str | None = None
    sum_of: Sequence[str] = ()
    correct: str | None = None
    grow: str | None = None
    grow_with: Sequence[str] = ()
    grow_within: tuple[str, str] | None = None
    cap: tuple[str, float] | None = None


def row_targets(areas: DataFrame, spec: Sequence[Target]) -> DataFrame:
    """areas plus a column for each target, in the order of spec. A missing value counts as
    no one; a group whose parts are zero stays zero."""
    out, raw = areas, {}
    for t in spec:
        value = reduce(lambda a, b: a + b, [F.col(c) for c in t.sum_of]) if t.sum_of else F.expr(t.expr)
        value = F.coalesce(value.cast("double"), F.lit(0.0))
        if t.correct:
            value = value * F.coalesce(F.col(t.correct), F.lit(1.0))
        raw[t.name] = f"_raw_{t.name}"
        out = out.withColumn(raw[t.name], value)
        grown = F.col(raw[t.name])
        if t.grow:
            grown = grown * F.coalesce(F.col(t.grow), F.lit(1.0))
        if t.grow_with:
            parts = lambda names: reduce(lambda a, b: a + b, [F.col(c) for c in names])
            before = parts([raw[c] for c in t.grow_with])
            grown = grown * F.when(before != 0, parts(t.grow_with) / before).otherwise(1.0)
        out = out.withColumn(t.name, grown)
        if t.grow_within:
            group, total = t.grow_within
            sums = out.groupBy(group).agg(F.sum(t.name).alias("_sum"))
            out = out.join(sums, group).withColumn(t.name, F.when(F.col("_sum") != 0, F.col(t.name) * F.col(total) / F.col("_sum")).otherwise(F.col(t.name))).drop("_sum")
        if t.cap:
            out = out.withColumn(t.name, F.least(F.col(t.name), t.cap[1] * F.col(t.cap[0])))
    return out.drop(*raw.values())


def area_targets(areas: DataFrame, sampled: DataFrame, area: str, zone: str, locality: str, targets: Sequence[str]) -> DataFrame:
    """Per area: its zone, sampled households (zero if none), localities, and target sums."""
    per = areas.groupBy(area).agg(F.min(zone).alias(zone), F.count_distinct(locality).alias("localities"), *[F.sum(t).alias(t) for t in targets])
    return per.join(sampled.groupBy(area).agg(F.count("*").alias("sampled")), area, "left").na.fill(0, ["sampled"])


def build_constraints(targets: DataFrame, zone: str, names: Sequence[str]) -> DataFrame:
    """(zone, constraint, target) in long form, zero targets included."""
    told = F.array(*[F.struct(F.lit(n).alias("constraint"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("target")) for n in names])
    return targets.groupBy(zone).agg(*[F.sum(n).alias(n) for n in names]).select(zone, F.inline(told))


def check_constraint_set(
    constraints: DataFrame, records: DataFrame, zone: str, columns: dict[str, str],
    equal: dict[str, Sequence[str]] | None = None, at_most: dict[str, Sequence[str]] | None = None, tolerance: float = 1e-6,
) -> DataFrame:
    """(check, rows): repeated (zone, constraint); null or negative targets; zones of records
    without constraints and of constraints without records; zones where the parts of a
    whole do not add up to it (equal) or exceed it (at_most); and targets above zero that
    no record of the zone supports (columns: constraint to the record column)."""
    told = F.array(*[F.struct(F.lit(n).alias("constraint"), (F.col(c) > 0).alias("has")) for n, c in columns.items()])
    support = records.select(zone, F.inline(told)).groupBy(zone, "constraint").agg(F.max("has").alias("has"))
    zones = [d.select(zone).distinct() for d in (records, constraints)]
    rows = {
        "repeated": constraints.groupBy(zone, "constraint").agg(F.count("*").alias("n")).where("n > 1"),
        "null_or_negative": constraints.where(F.coalesce(F.col("target") < 0, F.lit(True)) | F.isnan("target")),
        "zone_without_constraints": zones[0].join(zones[1], zone, "left_anti"),
        "zone_without_records": zones[1].join(zones[0], zone, "left_anti"),
        "unsupported": constraints.where("target > 0").join(support.where("has"), [zone, "constraint"], "left_anti"),
    }
    total = lambda names: F.sum(F.when(F.col("constraint").isin(*names), F.col("target")).otherwise(0.0))
    for kind, wholes in (("parts_differ", equal or {}), ("parts_exceed", at_most or {})):
        for whole, parts in wholes.items():
            gap = total(parts) - total([whole])
            bad = constraints.groupBy(zone).agg(gap.alias("gap"), total([whole]).alias("whole"))
            off = F.abs("gap") if kind == "parts_differ" else F.col("gap")
            rows[f"{kind}:{whole}"] = bad.where(off > tolerance * F.greatest(F.lit(1.0), F.abs("whole")))
    counted = [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("check"), "rows") for n, d in rows.items()]
    return reduce(DataFrame.union, counted)


@dataclass(frozen=True)
class Constraint:
    """A target by geography: an SQL expression over sums of `columns` by the geography, or
    a constant for each of its ids; a constant is multiplied by the column `share` of the
    coverage table and the column `growth` of the growth table, where they are named."""

    name: str
    geography: str
    expr: str | None = None
    columns: Sequence[str] = ()
    constant: dict | None = None
    share: str | None = None
    growth: str | None = None


def constraint_set(universe: DataFrame, spec: Sequence[Constraint], shares: dict[str, DataFrame] | None = None, growth: dict[str, DataFrame] | None = None) -> DataFrame:
    """(geography, id, constraint, target) in long form.

    A sum is null where all cells of a column are suppressed (null), and so is an
    expression that reads it: a suppressed target is not a target of zero. shares and
    growth hold, by geography, tables of its ids. A constant whose ids are not those of
    the universe, or an id without the share or growth asked for, is an error.
    """
    parts = []
    for geography in dict.fromkeys(c.geography for c in spec):
        own = [c for c in spec if c.geography == geography]
        summed = sorted({x for c in own for x in c.columns})
        sums = universe.where(F.col(geography).isNotNull()).groupBy(geography).agg(F.count("*").alias("_rows"), *[F.sum(x).alias(x) for x in summed])
        for kind, tables in (("share", shares), ("growth", growth)):
            used = sorted({getattr(c, kind) for c in own if getattr(c, kind)})
            if used:
                if geography not in (tables or {}):
                    raise ValueError(f"no {kind} table for {geography}")
                sums = sums.join(tables[geography].select(geography, *[F.col(x).alias(f"_{kind}_{x}") for x in used]), geography, "left")
        values = []
        for c in own:
            if c.constant is not None:
                ids = {r[0] for r in sums.select(geography).limit(len(c.constant) + 1).collect()}
                if ids != set(c.constant):
                    raise ValueError(f"{c.name}: constants for {sorted(map(str, c.constant))}, not the ids of {geography}")
                value = F.create_map(*[F.lit(x) for k, v in c.constant.items() for x in (k, float(v))])[F.col(geography)]
                for kind in ("share", "growth"):
                    if getattr(c, kind):
                        factor = F.col(f"_{kind}_{getattr(c, kind)}")
                        told = F.concat(F.lit(f"{c.name}: no {kind} for {geography} "), F.col(geography).cast("string"))
                        value = value * F.coalesce(factor.cast("double"), F.raise_error(told).cast("double"))
            else:
                value = F.expr(c.expr)
            values.append(F.struct(F.lit(c.name).alias("constraint"), value.cast("double").alias("target")))
        parts.append(sums.select(F.lit(geography).alias("geography"), F.col(geography).cast("string").alias("id"), F.inline(F.array(*values))))
    return reduce(DataFrame.unionByName, parts)
