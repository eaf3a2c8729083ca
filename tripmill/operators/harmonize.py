"""Spec-driven recoding of answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def harmonize_map(df: DataFrame, column: str, mapping: dict, allowed: Sequence = (), fallback=None) -> DataFrame:
    """Recode a column; NULL stays, allowed codes take the fallback, any other unmapped
    code is an error that names it."""
    odd = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*mapping, *allowed)).select(column).distinct().limit(10).collect()
    if odd:
        raise ValueError(f"{column}: unmapped {sorted(str(r[0]) for r in odd)}")
    chain = reduce(lambda w, kv: w.when(F.col(column) == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.col(column).isNull(), F.lit(None)))
    return df.withColumn(column, chain.otherwise(F.lit(fallback)))


def number_variable(parts: Sequence[str], divide: float = 1, unspecified: Sequence[float] = (), cap: float | None = None) -> Column:
    """Sum of parsed columns, NULL if all are; unspecified codes are NULL; divided, capped."""
    numbers = [F.trim(F.col(p).cast("string")).try_cast("double") for p in parts]
    clean = [F.when(~n.isin(*unspecified), n) if unspecified else n for n in numbers]
    total = F.when(F.coalesce(*clean).isNotNull(), reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) for c in clean])) / divide
    return F.when(total.isNotNull(), F.least(total, F.lit(float(cap)))) if cap is not None else total


def bins_variable(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False, missing: str = "missing") -> Column:
    """Labels of bins with open ends; closed left, or right."""
    out = F.when(c.isNull(), missing)
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge if right else c < edge, label)
    return out.otherwise(labels[len(edges)])


def rules_variable(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Ordered rules, later ones override."""
    out = F.lit(default)
    for test, value in rules:
        out = F.when(test, value).otherwise(out)
    return out


def prepare_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], missing: str = "missing") -> DataFrame:
    """Numbers coerced; categories trimmed, blank or NULL to the missing label."""
    text = {c: F.trim(F.col(c).cast("string")) for c in categorical}
    return df.withColumns(
        {c: F.col(c).try_cast("double") for c in numeric} | {c: F.when(F.length(t) > 0, t).otherwise(missing) for c, t in text.items()}
    )


def unsupported_levels(df: DataFrame, training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, rows): rows whose level has no training row."""
    parts = []
    for c in columns:
        levels = training.select(c).distinct()
        parts.append(df.join(levels, c, "left_anti").agg(F.count("*").alias("rows")).select(F.lit(c).alias("feature"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def normalize_weights(df: DataFrame, weight: str) -> DataFrame:
    """Weights to mean one; a NULL weight is an error."""
    stats = df.agg(F.avg(weight).alias("_mean"), F.sum(F.col(weight).isNull().cast("int")).alias("_nulls"))
    checked = stats.withColumn("_mean", F.when(F.col("_nulls") > 0, F.raise_error(F.lit(f"{weight} has NULLs")).cast("double")).otherwise(F.col("_mean")))
    return df.crossJoin(F.broadcast(checked.select("_mean"))).withColumn(weight, F.col(weight) / F.col("_mean")).drop("_mean")


def map_variable(
    df: DataFrame, column: str, name: str, mapping: dict, divide: int | None = None, otherwise=None, domain: Sequence = (), missing: str | None = None
) -> DataFrame:
    """df with `name`: the level of a code, floor-divided first if asked. Another code of the
    domain takes the level `otherwise`; null takes the missing label (stays null without
    one); a code outside mapping and domain is an error that names it."""
    code = F.floor(F.col(column) / divide) if divide else F.col(column)
    known = [*mapping, *(domain if otherwise is not None else ())]
    odd = df.where(code.isNotNull() & ~code.isin(*known)).select(code.alias("c")).distinct().limit(10).collect()
    if odd:
        raise ValueError(f"{column}: codes outside the domain {sorted(str(r[0]) for r in odd)}")
    level = F.when(code.isNull(), F.lit(missing))
    for value, to in mapping.items():
        level = level.when(code == value, F.lit(to))
    return df.withColumn(name, level.otherwise(F.lit(otherwise)))


def assert_known_levels(df: DataFrame, levels: dict[str, Sequence[str]], most: int = 5) -> DataFrame:
    """df as it is; a value outside a column's declared levels is an error that names the
    columns and up to `most` values each."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.when(~F.col(c).isin(*v), F.col(c).cast("string")).alias("v")) for c, v in levels.items()]))
    odd = df.select(told.alias("x")).where("x.v IS NOT NULL").select("x.*").distinct()
    found = odd.groupBy("c").agg(F.slice(F.array_sort(F.collect_set("v")), 1, most).alias("v")).collect()
    if found:
        raise ValueError(f"undeclared levels: { {r['c']: r['v'] for r in found} }")
    return df
