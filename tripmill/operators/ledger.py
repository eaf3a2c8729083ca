"""The ledger of hand decisions: what each does to the tables, and the tables it makes.

A decision is (person, trip, field, before, after). Status decisions come first: they drop
a row or bring one back; then the others are read on the rows that are there, a field of a
dropped row being moot. The trip 0 stands for the person, whose one answer to where the day
started is no trip's value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import stage

STATUS, NOTE, DROPPED, RESTORED = "status", "note", "dropped", "restored"


@dataclass(frozen=True)
class Ledger:
    """What decisions may set: field -> closed list of labels (None: any value); answer: the
    person-level field; mode: the field that legs carry too; zone_of: area field -> (zone
    column, table of area and zone)."""

    fields: dict[str, Sequence[str] | None]
    answer: str = "answer"
    mode: str | None = None
    zone_of: dict[str, tuple[str, DataFrame]] | None = None


def _brought_back(status: DataFrame, rules: DataFrame, shipped: DataFrame, key: Sequence[str]) -> DataFrame:
    """The restored rows: as the rules hold them, else as shipped."""
    back = status.where(f"outcome = 'apply' AND told = '{RESTORED}'").select(*key).distinct()
    kept = rules.join(back, list(key), "left_semi")
    lost = shipped.join(back, list(key), "left_semi").join(rules.select(*key), list(key), "left_anti")
    return kept.unionByName(lost.select(*kept.columns))


def resolve(
    decisions: DataFrame, current: DataFrame, rules: DataFrame, shipped: DataFrame, ledger: Ledger, person: str = "person", trip: str = "trip", legs: DataFrame | None = None
) -> DataFrame:
    """decisions plus `value` (what the field takes, in the label's own spelling) and `outcome`:
    apply; holds (it is so already); moot (a field of a row that is dropped, the answer
    anywhere but on the person or their first trip, or of a person left without a trip);
    stale (its `before` or its row is gone); problem (a field, label or status that there
    is not, a mode that none of several legs has); note. Values are compared as text."""
    key = [person, trip]
    there = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    # written: rows, persons and outcomes all start from it
    d = stage(decisions.withColumn("told", F.lower(F.trim("after"))).join(there(current, "_now"), key, "left").join(there(shipped, "_was"), key, "left"))
    now, was = F.col("_now").isNotNull(), F.col("_was").isNotNull()
    on_status = F.when(F.col("told") == DROPPED, F.when(now, "apply").when(was, "holds").otherwise("stale")).when(
        F.col("told") == RESTORED, F.when(now, "holds").when(was, "apply").otherwise("stale")
    ).otherwise("problem")
    status = d.where(F.col("field") == STATUS).withColumns({"outcome": on_status, "value": F.col("told")})
    notes = d.where(F.col("field") == NOTE).withColumns({"outcome": F.lit("note"), "value": F.lit(None).cast("string")})

    text = lambda df: F.create_map(*[x for f in ledger.fields for x in (F.lit(f), F.col(f).cast("string"))])
    back = _brought_back(status, rules, shipped, key)
    rows = current.select(*key, text(current).alias("_values"), F.lit(False).alias("_back")).unionByName(back.select(*key, text(back).alias("_values"), F.lit(True).alias("_back")))
    gone = status.where(F.col("told") == DROPPED).select(*key).distinct().withColumn("_gone", F.lit(True))
    rows = rows.join(gone, key, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    first = F.min_by(F.struct(F.element_at("_values", ledger.answer).alias("a")), trip)
    people = rows.groupBy(person).agg(first.getField("a").alias("_answer"), F.max(~F.col("_gone")).alias("_keeps"))
    heads = current.groupBy(person).agg(F.min(trip).alias("_head"))
    shown = shipped.select(*key, text(shipped).alias("_shipped"))
    f = d.where(~F.col("field").isin(STATUS, NOTE)).drop("_now", "_was")
    f = f.join(rows, key, "left").join(shown, key, "left").join(people, person, "left").join(heads, person, "left")

    labels = F.lit(None).cast("string")
    closed = {name: levels for name, levels in ledger.fields.items() if levels is not None}
    for name, levels in closed.items():
        own = F.create_map(*[x for v in levels for x in (F.lit(v.lower()), F.lit(v))])
        labels = F.when(F.col("field") == name, own[F.col("told")]).otherwise(labels)
    f = f.withColumn("value", F.when(F.col("field").isin(*closed), labels).otherwise(F.trim("after")))
    value = F.col("value")
    about_person = F.col("field") == ledger.answer
    holds_now = F.when(about_person, F.col("_answer")).otherwise(F.col("_values")[F.col("field")])
    # a restored row is shown as it was shipped
    told = F.when(about_person, F.col("_answer")).when(F.coalesce("_back", F.lit(False)), F.col("_shipped")[F.col("field")]).otherwise(F.col("_values")[F.col("field")])
    odd_mode = F.lit(False)
    if legs is not None and ledger.mode:
        modes = legs.groupBy(*key).agg(F.collect_set(F.col(ledger.mode).cast("string")).alias("_modes"), F.count("*").alias("_legs"))
        f = f.join(modes, key, "left")
        odd_mode = (F.col("field") == ledger.mode) & (F.col("_legs") > 1) & ~F.array_contains("_modes", value)
    outcome = (
        F.when(~F.col("field").isin(*ledger.fields), "problem")
        .when(about_person & (F.col(trip) != 0) & ~F.col(trip).eqNullSafe(F.col("_head")), "moot")
        .when(about_person & F.col("_keeps").isNull(), "stale").when(about_person & ~F.col("_keeps"), "moot")
        .when(~about_person & F.coalesce("_gone", F.lit(False)), "moot").when(~about_person & F.col("_values").isNull(), "stale")
        .when(value.isNull(), "problem").when(holds_now.eqNullSafe(value), "holds").when(F.coalesce(odd_mode, F.lit(False)), "problem")
        .when(~told.eqNullSafe(F.col("before")), "stale").otherwise("apply")
    )
    dropped_later = gone.withColumnRenamed("_gone", "_later")
    f = f.join(dropped_later, key, "left").withColumn("outcome", F.when(~about_person & F.col("field").isin(*ledger.fields) & F.col("_later").isNotNull(), "moot").otherwise(outcome))
    columns = [*decisions.columns, "value", "outcome"]
    return status.select(*columns).unionByName(notes.select(*columns)).unionByName(f.select(*columns))


def apply_ledger(
    current: DataFrame, legs: DataFrame, persons: DataFrame, resolved: DataFrame, rules: DataFrame, shipped: DataFrame, all_legs: DataFrame, ledger: Ledger,
    person: str = "person", trip: str = "trip", counted: str = "trips", fixes: str = "fixes", mark: Callable[[DataFrame], DataFrame] | None = None, skip_stale: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, legs, persons) with what resolve() says applies: fields set, zones following
    their areas, rows and their legs dropped or brought back (legs from all_legs), the one
    leg of a trip taking its mode, one answer a person, the persons' `counted` trips
    adjusted, `fixes` recomputed from the values against shipped and rules, and, by `mark`,
    the issues. Nothing is applied if a decision is a problem or, unless skipped, stale."""
    key = [person, trip]
    resolved = stage(resolved)
    bad = resolved.where(F.col("outcome").isin("problem", *([] if skip_stale else ["stale"]))).limit(5).collect()
    if bad:
        raise ValueError(f"decisions that cannot be applied: {[r.asDict() for r in bad]}")
    go = resolved.where("outcome = 'apply'").withColumn("told", F.lower(F.trim("after")))
    status = go.where(F.col("field") == STATUS)
    back = _brought_back(status, rules, shipped, key)
    drop = status.where(F.col("told") == DROPPED).select(*key).distinct()
    out = current.unionByName(back.select(*current.columns)).join(drop, key, "left_anti")
    kinds = dict(current.dtypes)
    own = [f for f in ledger.fields if f != ledger.answer]
    wide = go.where(F.col("field").isin(*own)).groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_set_{f}") for f in own])
    out = out.join(wide, key, "left")
    for f, (zone, table) in (ledger.zone_of or {}).items():
        moved = table.select(F.col(f).cast("string").alias(f"_set_{f}"), F.col(zone).alias(f"_zone_{f}"))
        out = out.join(F.broadcast(moved), f"_set_{f}", "left").withColumn(zone, F.coalesce(F.when(F.col(f"_set_{f}").isNotNull(), F.col(f"_zone_{f}")), F.col(zone)))
    out = out.withColumns({f: F.coalesce(F.col(f"_set_{f}").cast(kinds[f]), F.col(f)) for f in own})
    given = go.where(F.col("field") == ledger.answer).groupBy(person).agg(F.max("value").alias("_given"))
    first = F.first(ledger.answer).over(Window.partitionBy(person).orderBy(trip).rowsBetween(Window.unboundedPreceding, 0))
    out = out.join(given, person, "left").withColumn(ledger.answer, F.coalesce("_given", first))

    new_legs = all_legs.join(back.select(*key), key, "left_semi").join(legs.select(*key).distinct(), key, "left_anti")
    kept = legs.unionByName(new_legs.select(*legs.columns)).join(drop, key, "left_anti")
    if ledger.mode:
        modes = wide.select(*key, F.col(f"_set_{ledger.mode}").alias("_mode"))
        single = kept.groupBy(*key).agg(F.count("*").alias("_n"))
        kept = kept.join(modes, key, "left").join(single, key, "left")
        kept = kept.withColumn(ledger.mode, F.when((F.col("_n") == 1) & F.col("_mode").isNotNull(), F.col("_mode")).otherwise(F.col(ledger.mode))).select(*legs.columns)

    change = status.groupBy(person).agg((F.count_if(F.col("told") == RESTORED) - F.count_if(F.col("told") == DROPPED)).alias("_change"))
    people = persons.join(change, person, "left").withColumn(counted, F.col(counted) + F.coalesce("_change", F.lit(0))).select(*persons.columns)

    out = out.select(*current.columns)
    out = net_fixes(out, shipped, rules, key, list(ledger.fields), fixes)
    return (mark(out) if mark else out), kept, people


def net_fixes(trips: DataFrame, shipped: DataFrame, rules: DataFrame, key: Sequence[str], fields: Sequence[str], fixes: str) -> DataFrame:
    """trips with fixes recomputed: the rule's code `<field>:...` stands where the value is the
    rule's and not the shipped one; a value that is neither is `<field>:revision`; a row
    that the rules do not hold is `row:revision`."""
    side = lambda df, name: df.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields], *([F.col(fixes)] if name == "_r" else [])).alias(name))
    d = trips.join(side(shipped, "_s"), list(key), "left").join(side(rules, "_r"), list(key), "left")
    ruled = F.col("_r").isNotNull()
    same = lambda name, f: F.col(name).isNotNull() & F.col(f).cast("string").eqNullSafe(F.col(f"{name}.{f}"))
    told = F.filter(F.split(F.coalesce(F.when(ruled, F.col(f"_r.{fixes}")), F.lit("")), ";"), lambda c: c != "")

    def stands(code: Column) -> Column:
        test = F.lit(True)
        for f in fields:
            test = F.when(F.split_part(code, F.lit(":"), F.lit(1)) == f, same("_r", f) & ~same("_s", f)).otherwise(test)
        return test

    own: list[Column] = [F.when(~same("_r", f) & ~same("_s", f), f"{f}:revision") for f in fields]
    codes = F.concat(F.filter(told, stands), F.array_compact(F.array(*own, F.when(~ruled, "row:revision"))))
    return d.withColumn(fixes, F.array_join(codes, ";")).select(*trips.columns)
