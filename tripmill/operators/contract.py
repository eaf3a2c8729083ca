"""Contracts of tables and specs: what is loaded, recoded, looked up and attached, or an error."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOWN = 10


def none_of(bad: DataFrame, message: str) -> None:
    """An error that names up to SHOWN rows of bad, if it has any."""
    rows = bad.limit(SHOWN).collect()
    if rows:
        raise ValueError(f"{message}: {', '.join('/'.join(map(str, r)) for r in rows)}")


def parse_survey_date(c: Column) -> Column:
    """Day, short month and two-digit year; 69 to 99 are of the last century. What cannot be
    read is null."""
    day = F.try_to_timestamp(c, F.lit("d-MMM-yy")).cast("date")
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


@dataclass(frozen=True)
class Rule:
    """What a column must hold: a type, listed levels, no nulls, a range, text lengths."""

    type: str
    nullable: bool = True
    levels: Sequence | None = None
    low: float | None = None
    high: float | None = None
    lengths: Sequence[int] | None = None


def schema_violations(df: DataFrame, rules: dict[str, Rule], key: Sequence[str]) -> DataFrame:
    """(column, rule, rows) of every broken rule; repeated keys count each key once."""
    tests: list[tuple[str, str, Column]] = []
    for name, rule in rules.items():
        raw = F.col(name)
        value = raw.try_cast(rule.type)
        tests.append((name, "type", raw.isNotNull() & value.isNull()))
        if not rule.nullable:
            tests.append((name, "null", raw.isNull()))
        if rule.levels is not None:
            tests.append((name, "level", value.isNotNull() & ~value.isin(*rule.levels)))
        if rule.low is not None or rule.high is not None:
            low = value < rule.low if rule.low is not None else F.lit(False)
            tests.append((name, "range", low | (value > rule.high if rule.high is not None else F.lit(False))))
        if rule.lengths is not None:
            tests.append((name, "length", value.isNotNull() & ~F.length(value).isin(*rule.lengths)))
    counts = df.agg(*[F.count_if(t).alias(f"_{i}") for i, (_, _, t) in enumerate(tests)])
    told = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"_{i}").alias("rows")) for i, (c, r, _) in enumerate(tests)])
    found = counts.select(F.inline(told))
    keys = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = keys.agg(F.count("*").alias("rows")).select(F.lit("+".join(key)).alias("column"), F.lit("key").alias("rule"), "rows")
    return found.unionByName(repeated).where("rows > 0")


def conform_schema(df: DataFrame, rules: dict[str, Rule], key: Sequence[str]) -> DataFrame:
    """df in the declared types; columns beyond the rules, missing ones and broken rules are
    an error."""
    odd = sorted(set(df.columns) ^ set(rules))
    if odd:
        raise ValueError(f"columns that are missing or too many: {', '.join(odd)}")
    none_of(schema_violations(df, rules, key), "broken rules")
    return df.select(*[F.col(c).cast(rule.type).alias(c) for c, rule in rules.items()])


def pool_waves(waves: dict[str, DataFrame], weight: str, household: Sequence[str], key: str = "hh") -> DataFrame:
    """The rows of all waves, tagged `period`, with a household key of the given parts and
    weights divided by the number of waves."""
    tagged = [df.withColumn("period", F.lit(name)) for name, df in waves.items()]
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return pooled.withColumns({weight: F.col(weight) / len(waves), key: F.concat_ws("-", *[F.col(c).cast("string") for c in household])})


def read_decisions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A CSV (compressed or not) of text columns; keys are numbers; empty text stays text."""
    df = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in df.columns if c not in keys}
    return df.withColumns(blank | {c: F.col(c).cast("long") for c in keys})


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet", decimals: int = 6) -> None:
    """Each table in its own folder; numbers of CSV files have fixed decimals."""
    for name, df in tables.items():
        if form == "csv":
            fixed = {f.name: F.format_string(f"%.{decimals}f", f.name) for f in df.schema if f.dataType.typeName() in ("double", "float")}
            df.withColumns(fixed).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


@dataclass(frozen=True)
class Variable:
    """A recoded column and the columns, raw or recoded before it, that it reads."""

    name: str
    column: Callable[[], Column]
    reads: Sequence[str] = ()


def needed_variables(spec: Sequence[Variable], *wanted: str) -> list[Variable]:
    """The variables that the wanted ones need, themselves included, in the order of spec. A
    variable reads the last one before it of that name."""
    needed, out = set(wanted), []
    for v in reversed(spec):
        if v.name in needed:
            needed = (needed - {v.name}) | set(v.reads)
            out.append(v)
    return out[::-1]


def apply_variables(df: DataFrame, spec: Sequence[Variable], *wanted: str) -> DataFrame:
    """df with the variables (those that wanted ones need, if any is given) added in order."""
    for v in needed_variables(spec, *wanted) if wanted else spec:
        df = df.withColumn(v.name, v.column())
    return df


def strict_lookup(df: DataFrame, column: str, table: DataFrame, code: str, value: str) -> DataFrame:
    """df plus value of each code; a code that the table lacks, or has without a value, is an
    error. The table must hold each code once."""
    none_of(table.groupBy(code).agg(F.count("*").alias("_n")).where("_n > 1").select(code), f"{code}: repeated")
    pairs = table.select(F.col(code).alias(column), F.col(value))
    none_of(df.select(column).where(F.col(column).isNotNull()).distinct().join(pairs.where(F.col(value).isNotNull()), column, "left_anti"), f"{column}: no {value}")
    return df.join(pairs, column, "left")


def leg_slot_audit(df: DataFrame, modes: Sequence[str], minutes: Sequence[str], declared: str, main: str) -> DataFrame:
    """df plus used (slots with a mode), gap (an empty slot before a used one), count_ok,
    main_used, main_longest and ties (modes as long as the longest)."""
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).alias("mode"), F.col(t).alias("minutes")) for i, (m, t) in enumerate(zip(modes, minutes), 1)])
    out = df.withColumn("_s", F.filter(slots, lambda s: s["mode"].isNotNull()))
    longest = F.array_max(F.transform("_s", lambda s: s["minutes"]))
    out = out.withColumn("_l", F.filter("_s", lambda s: s["minutes"] == longest))
    return out.withColumns(
        {
            "used": F.size("_s").cast("long"), "gap": F.coalesce(F.array_max(F.transform("_s", lambda s: s["i"])), F.lit(0)) > F.size("_s"),
            "count_ok": F.coalesce(F.size("_s") == F.col(declared), F.lit(False)), "main_used": F.exists("_s", lambda s: s["mode"] == F.col(main)),
            "main_longest": F.exists("_l", lambda s: s["mode"] == F.col(main)), "ties": F.size("_l").cast("long"),
        }
    ).drop("_s", "_l")


def imputed_attribute(df: DataFrame, keys: Sequence[str], answer: str, shares: DataFrame, p: str, complement: bool = False) -> DataFrame:
    """answer, or where it is missing the class probability p (or what it leaves of one); an
    unanswered row without one is an error."""
    value = 1 - F.col("_p") if complement else F.col("_p")
    out = df.join(shares.select(*keys, F.col(p).alias("_p")), list(keys), "left")
    none_of(out.where(F.col(answer).isNull() & F.col("_p").isNull()).select(*keys), f"{answer}: neither an answer nor a probability")
    return out.withColumn(answer, F.coalesce(F.col(answer).cast("double"), value)).drop("_p")


def leg_count_attribute(legs: DataFrame, keys: Sequence[str], mode: str, counted: dict[str, int], once: bool = False) -> DataFrame:
    """(keys, legs): sum of what the modes of a trip count, at most one with `once`."""
    table = F.create_map(*[F.lit(x) for kv in counted.items() for x in kv])
    total = F.coalesce(F.sum(table[F.col(mode)]), F.lit(0))
    return legs.groupBy(*keys).agg((F.least(total, F.lit(1)) if once else total).cast("long").alias("legs"))


def zone_ids(df: DataFrame, zone: str, municipality: str, zones: Sequence[str], municipalities: Sequence[str]) -> DataFrame:
    """df plus zone_id (place in the list of zones, from one) and cell (zone * 1000 plus the
    place of the municipality); an unlisted name is an error."""
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    out = df.withColumns({"zone_id": place(zone, zones), "_m": place(municipality, municipalities)})
    none_of(out.where(F.coalesce(F.least("zone_id", "_m"), F.lit(0)) == 0).select(zone, municipality).distinct(), "unlisted")
    return out.withColumn("cell", F.col("zone_id") * 1000 + F.col("_m")).drop("_m")


def area_units_crosswalk(units: DataFrame, urban: DataFrame, localities: DataFrame, unit: str, urban_key: str, locality_key: str) -> DataFrame:
    """units with the columns of their area: of the urban area where they have its key, else
    of the locality; a unit without an area is an error."""
    in_town = F.col(urban_key).isNotNull()
    done = units.where(in_town).join(urban, urban_key).unionByName(units.where(~in_town).join(localities, locality_key), allowMissingColumns=True)
    none_of(units.join(done.select(unit).distinct(), unit, "left_anti").select(unit), f"{unit}: no area")
    return done


def attach_draw(df: DataFrame, keys: Sequence[str], draws: DataFrame, number: int, value: str, needed: Column) -> DataFrame:
    """df with a missing value taken from one draw where it is needed; a needed value that the
    draw lacks is an error."""
    one = draws.where(F.col("draw") == number).select(*keys, F.col(value).alias("_drawn"))
    out = df.join(one, list(keys), "left").withColumn("_need", F.coalesce(needed, F.lit(False)) & F.col(value).isNull())
    none_of(out.where("_need AND _drawn IS NULL").select(*keys), f"{value}: not in draw {number}")
    return out.withColumn(value, F.when(F.col("_need"), F.col("_drawn")).otherwise(F.col(value))).drop("_drawn", "_need")
