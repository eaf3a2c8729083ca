"""Cleaning, projections and filters of survey tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_tokens(df: DataFrame, tokens: Sequence[str] = ("N/D", "ND", "")) -> DataFrame:
    """String cells equal to a token become NULL."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in strings})


def unpivot_legs(trips: DataFrame, keys: Sequence[str], slots: Sequence[dict[str, str]], need: str) -> DataFrame:
    """One row for each slot whose `need` field is answered; leg is the slot's number.

    slots: for each slot a map of field name to column name.
    """
    legs = F.array(*[F.struct(*[F.col(c).alias(f) for f, c in slot.items()]) for slot in slots])
    out = trips.select(*keys, F.posexplode(legs).alias("leg", "slot")).select(*keys, (F.col("leg") + 1).alias("leg"), "slot.*")
    return out.where(F.col(need).isNotNull())


def trip_minutes(trips: DataFrame, legs: DataFrame, keys: Sequence[str], minutes: str = "minutes") -> DataFrame:
    """Travel minutes of each trip; a trip without legs or minutes has none."""
    total = legs.groupBy(*keys).agg(F.sum(minutes).alias("_sum"))
    return trips.join(total, list(keys), "left").withColumn("trip_minutes", F.coalesce("_sum", F.lit(0))).drop("_sum")


def select_rows(df: DataFrame, keep: dict[str, Sequence] | None = None, drop: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows in the kept and not in the dropped values, compared as text; NULL is in no
    list."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))
    tests = [text(c).isin(*map(str, v)) for c, v in (keep or {}).items()] + [~text(c).isin(*map(str, v)) for c, v in (drop or {}).items()]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def patch_cells(df: DataFrame, fixes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Replace `column` by the fix of the same keys; fixes (keys, value), a small table."""
    fix = fixes.select(*keys, F.col("value").alias("_fix"))
    return df.join(fix, list(keys), "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def inherited_columns(child: DataFrame, parent_key: str) -> DataFrame:
    """(column, inherited): columns with at most one distinct answer for each parent.

    Minimum equals maximum says so without expanding rows as distinct counts do.
    """
    columns = [c for c in child.columns if c != parent_key]
    same = child.groupBy(parent_key).agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    flags = same.agg(*[F.min(c).alias(c) for c in columns])
    return flags.unpivot([], columns, "column", "inherited")


def spec_attributes(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Integer attributes from a spec: {name: {column, values, default} or {column, low,
    high, when}}; a NULL gives the default or 0."""
    out = {}
    for name, s in spec.items():
        c = F.col(s["column"])
        if "values" in s:
            chain = reduce(lambda w, kv: w.when(c == kv[0], kv[1]), s["values"].items(), F.when(F.lit(False), 0))
            out[name] = chain.otherwise(s.get("default", 0))
        else:
            low, high = s.get("low"), s.get("high")
            inside = (c >= low if low is not None else F.lit(True)) & (c < high if high is not None else F.lit(True))
            if "when" in s:
                inside &= F.expr(s["when"])
            out[name] = F.when(inside & c.isNotNull(), 1).otherwise(0)
    return df.withColumns({k: v.cast("long") for k, v in out.items()})


def area_key(parts: Sequence[str], widths: Sequence[int]) -> Column:
    """Zero-padded geographic key."""
    return F.concat(*[F.lpad(F.col(p).cast("string"), w, "0") for p, w in zip(parts, widths)])


def time_text(minutes: Column) -> Column:
    """Minutes after midnight as HH:MM."""
    return F.format_string("%02d:%02d", (F.floor(minutes / 60)).cast("int"), (minutes % 60).cast("int"))


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """0-based dense ids over the sorted distinct keys, without a global window: keys are
    range-partitioned and numbered from their partition's offset."""
    keys = df.select(key).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    placed = keys.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"), F.min(key).alias("_low"))
    # one row for each partition: as many as spark.sql.shuffle.partitions at most
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = placed.join(F.broadcast(offsets.select("_part", "_off")), "_part").select(key, (F.col("_off") + F.col("_n") - 1).alias(name))
    return df.join(ids, key)


def flag_add(flags: Column, when: Column, code: str) -> Column:
    """Append code to an array of codes where the condition holds."""
    return F.when(when, F.array_append(flags, code)).otherwise(flags)


def has_any(flags: Column, codes: Sequence[str]) -> Column:
    """Whether a ';'-joined list of codes has one of codes."""
    return F.arrays_overlap(F.split(flags, ";"), F.array(*map(F.lit, codes)))


def table_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): equal tables give equal digests in whatever order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in sorted(df.columns)])), 1, 12), 16, 10)
    return df.select(h.cast("decimal(20,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """(column, rows_differing, max_abs_diff, status) of numeric columns of two tables."""
    joined = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(
        b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), list(keys), "full_outer"
    )
    aggs = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        aggs += [F.sum(F.when(~x.eqNullSafe(y), 1).otherwise(0)).alias(f"n_{c}"), F.max(F.abs(x - y)).alias(f"d_{c}")]
    wide = joined.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("rows_differing"), F.col(f"d_{c}").cast("double").alias("max_abs_diff")) for c in columns]))
    status = F.when(F.col("rows_differing") == 0, "identical").when(F.col("max_abs_diff") <= tolerance, "within").otherwise("different")
    return wide.select(rows.alias("r")).select("r.*").withColumn("status", status)


def flags_to_columns(df: DataFrame, flags: str, codes: Sequence[str]) -> DataFrame:
    """df with a boolean column for each code of a ';'-joined list, which goes; a null list has
    none."""
    held = F.split(F.coalesce(F.col(flags), F.lit("")), ";")
    return df.withColumns({c: F.array_contains(held, c) for c in codes}).drop(flags)


def drop_inherited(child: DataFrame, parent: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """child without the columns that repeat its parent's; a child row without a parent, or
    with another value than its parent's, is an error that names the columns."""
    told = parent.select(key, F.struct(*columns).alias("_parent"), F.lit(True).alias("_there"))
    joined = child.join(told, key, "left")
    wrong = joined.agg(
        F.count(F.when(F.col("_there").isNull(), 1)).alias("no_parent"),
        *[F.count(F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_parent.{c}")), 1)).alias(c) for c in columns],
    ).first().asDict()
    if any(wrong.values()):
        raise ValueError(f"child rows that differ from their {key}: { {k: n for k, n in wrong.items() if n} }")
    return child.drop(*columns)
