"""Keyed edits of cleaned tables: decisions (keys, field, before, after)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decision_outcomes(decisions: DataFrame, rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, outcome) of each decision against the rows as they are: problem (no
    such row), holds (the row has the new value), apply (it has the old one), else
    stale. Values are compared as text, nulls as values."""
    pairs = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    now = rows.select(key, pairs.alias("_now"), F.lit(True).alias("_there"))
    value = F.col("_now")[F.col("field")]
    outcome = (
        F.when(F.col("_there").isNull(), "problem").when(value.eqNullSafe(F.col("after")), "holds")
        .when(value.eqNullSafe(F.col("before")), "apply").otherwise("stale")
    )
    return decisions.join(now, key, "left").select(key, "field", outcome.alias("outcome"))


def apply_decisions(rows: DataFrame, decisions: DataFrame, key: str, fields: Sequence[str], drop: str = "drop") -> DataFrame:
    """rows with the decided values (decisions dealt to one column a field) and without
    the rows that a decision of field `drop` names."""
    wide = decisions.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.struct(F.col("after").alias("v")))).alias(f"_{f}") for f in fields],
        F.max((F.col("field") == drop).cast("int")).alias("_drop"),
    )
    out = rows.join(wide, key, "left").where(F.coalesce(F.col("_drop"), F.lit(0)) == 0)
    kinds = dict(rows.dtypes)
    decided = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").cast(kinds[f])).otherwise(F.col(f)) for f in fields}
    return out.withColumns(decided).select(*rows.columns)


def merge_decisions(kept: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Decisions (key, field, before, after) with edits upserted; an edit back to the
    value before removes the decision."""
    a = kept.select(key, "field", F.struct("before", "after").alias("_a"))
    b = edits.select(key, "field", F.struct("before", "after").alias("_b"))
    out = a.join(b, [key, "field"], "full_outer")
    before = F.coalesce("_a.before", "_b.before")
    after = F.when(F.col("_b").isNotNull(), F.col("_b.after")).otherwise(F.col("_a.after"))
    return out.select(key, "field", before.alias("before"), after.alias("after")).where("NOT before <=> after")


def net_fixes(rows: DataFrame, shipped: str, current: str, ruled: str, codes: str, field: str) -> DataFrame:
    """fix: null where the current value is the shipped one, the rule's codes where it is
    the rule's, else `<field>:revision`."""
    fix = F.when(F.col(current).eqNullSafe(F.col(shipped)), None).when(F.col(current).eqNullSafe(F.col(ruled)), F.col(codes))
    return rows.withColumn("fix", fix.otherwise(f"{field}:revision"))


def marked_persons(rows: DataFrame, person: str, flags: str, codes: Sequence[str]) -> DataFrame:
    """(person, marks, any_of): codes on a person's rows, and whether one of codes is."""
    each = rows.select(person, F.explode(F.split(flags, ";")).alias("code")).where("code <> ''")
    return each.groupBy(person).agg(F.count("*").alias("marks"), F.max(F.col("code").isin(*codes)).alias("any_of"))


def verify_edits(before: DataFrame, after: DataFrame, person: str, flags: str) -> DataFrame:
    """(person, cleared, made): sorted codes that the edits cleared or newly made."""
    codes = lambda df, name: df.groupBy(person).agg(F.array_distinct(F.flatten(F.collect_set(F.split(flags, ";")))).alias(name))
    out = codes(before, "_a").join(codes(after, "_b"), person, "full_outer")
    a, b = (F.array_remove(F.coalesce(c, F.array().cast("array<string>")), "") for c in ("_a", "_b"))
    text = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ";")
    return out.select(person, text(a, b).alias("cleared"), text(b, a).alias("made")).where("cleared <> '' OR made <> ''")
