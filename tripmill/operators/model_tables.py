"""The tables that a travel model reads: households, people and trips, and their contract."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import day_wraps, over
from .stats import medians

#: No zone; age from which one drives; age from which daycare is an escort's.
NO_ZONE, DRIVING_AGE, ESCORT_AGE = 0, 18, 12


@dataclass(frozen=True)
class Codes:
    """A lookup of labels and the code of any other label (or none)."""

    table: dict
    default: object = None

    def of(self, c: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in self.table.items() for x in kv])[c]
        return known if self.default is None else F.coalesce(known, F.lit(self.default))


def _needed(value: Column, needed: Column, what: str, key: Column) -> Column:
    """value, an error where a row that reads it has none."""
    told = F.concat(F.lit(f"no drawn {what} for "), key.cast("string"))
    return F.when(needed & value.isNull(), F.raise_error(told).cast("string")).otherwise(value)


def _with_draw(df: DataFrame, draws: DataFrame, keys: Sequence[str], draw: int, columns: Sequence[str]) -> DataFrame:
    one = draws.where(F.col("draw") == draw).select(*keys, *[F.col(c).alias(f"_drawn_{c}") for c in columns])
    return df.join(one, list(keys), "left")


def _weighted(df: DataFrame, weight: str, expansion: DataFrame | None, hh: str) -> DataFrame:
    """df with `expansion`, the own weight or the household's, which every row must have."""
    if expansion is None:
        return df.withColumn("expansion", F.col(weight).cast("double"))
    told = F.concat(F.lit("no expansion weight for household "), F.col(hh).cast("string"))
    given = expansion.select(hh, F.col(weight).cast("double").alias("_w"))
    return df.drop(weight).join(given, hh, "left").withColumn("expansion", F.coalesce("_w", F.raise_error(told).cast("double"))).drop("_w")


def model_households(
    households: DataFrame, members: DataFrame, draws: DataFrame, draw: int, hh: str, zone: str, size: tuple[str, Codes], vehicles: dict[str, Codes],
    level: tuple[str, Codes], weight: str, expansion: DataFrame | None = None,
) -> DataFrame:
    """(hh, zone, persons, vehicles, income_class, expansion): the reported size, raised to the
    listed members; vehicles of all kinds; the class of one draw, which every household
    must have."""
    listed = members.groupBy(hh).agg(F.count("*").alias("_listed"))
    d = _with_draw(households.join(listed, hh, "left"), draws, [hh], draw, [level[0]])
    told = size[1].of(F.col(size[0]))
    cars = sum((c.of(F.col(v)) for v, c in vehicles.items()), F.lit(0))
    drawn = _needed(F.col(f"_drawn_{level[0]}").cast("string"), F.lit(True), level[0], F.col(hh))
    d = _weighted(d, weight, expansion, hh)
    return d.select(
        hh, F.col(zone).alias("zone"), F.greatest(told, F.coalesce("_listed", F.lit(0))).cast("long").alias("persons"), cars.cast("long").alias("vehicles"),
        level[1].of(drawn).alias("income_class"), "expansion",
    )


@dataclass(frozen=True)
class PeopleCodes:
    """employment and occupation of answers and of draws; the code of people who do not work,
    of full-time workers, and what an informal one becomes; labels of students."""

    employment: Codes
    drawn_employment: Codes
    occupation: Codes
    drawn_occupation: Codes
    none: str = "O"
    full: str = "F"
    informal: dict = field(default_factory=dict)
    no_answer: str = "O"
    no_sector: str = "G"
    student_jobs: Sequence[str] = ()
    student_answers: Sequence[str] = ()
    drawn_student: str = "S"


def model_people(
    persons: DataFrame, trips: DataFrame, draws: DataFrame, draw: int, keys: Sequence[str], codes: PeopleCodes, work: Sequence[str], school: Sequence[str],
    daycare: str, weight: str, hh: str, expansion: DataFrame | None = None,
) -> DataFrame:
    """keys, employment, occupation, student, license, work_zone, school_zone, expansion.

    persons: keys, answer, sector, job, age; draws: keys, draw, situation, informal, sector,
    student; trips: keys, trip, motive, dest. Employment is the answer, else the draw (which
    must be there), else none; a full-time worker with drawn informality takes its code.
    The sector is the reported one, else the drawn one of those who work, and none for
    exactly those who do not. A student says so, goes to school, or is drawn if unanswered.
    """
    d = _with_draw(persons, draws, keys, draw, ["situation", "informal", "sector", "student"])
    who = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    answered = codes.employment.of(F.col("answer"))
    drawn = codes.drawn_employment.of(_needed(F.col("_drawn_situation"), answered.isNull(), "situation", who))
    d = d.withColumn("_work", F.coalesce(answered, drawn, F.lit(codes.no_answer)))
    if codes.informal:
        other = Codes(codes.informal).of(_needed(F.col("_drawn_informal"), F.col("_work") == codes.full, "informality", who))
        d = d.withColumn("_work", F.when((F.col("_work") == codes.full) & other.isNotNull(), other).otherwise(F.col("_work")))
    reported = codes.occupation.of(F.col("sector"))
    lacks = reported.isNull() & (F.col("_work") != codes.none)
    sector = F.coalesce(reported, codes.drawn_occupation.of(_needed(F.col("_drawn_sector"), lacks, "sector", who)), F.lit(codes.no_sector))
    sector = F.when(F.col("_work") == codes.none, codes.none).otherwise(sector)
    t = trips.join(persons.select(*keys, "age"), list(keys), "left")
    to_school = F.col("motive").isin(*school) | ((F.col("motive") == daycare) & (F.col("age") < ESCORT_AGE))
    first = lambda motives: F.min_by(F.when(F.col("motive").isin(*motives), F.col("dest")), F.when(F.col("motive").isin(*motives), F.col("trip")))
    seen = t.groupBy(*keys).agg(first(work).alias("_wz"), first(school).alias("_sz"), F.max(F.coalesce(to_school, F.lit(False))).alias("_went"))
    d = d.join(seen, list(keys), "left")
    unanswered = F.col("answer").isNull()
    says = F.coalesce(F.col("job").isin(*codes.student_jobs), F.lit(False)) | F.coalesce(F.col("answer").isin(*codes.student_answers), F.lit(False))
    drawn_student = unanswered & _needed(F.col("_drawn_student"), unanswered, "student status", who).eqNullSafe(F.lit(codes.drawn_student))
    student = says | F.coalesce("_went", F.lit(False)) | drawn_student
    d = _weighted(d, weight, expansion, hh)
    return d.select(
        *keys, F.col("_work").alias("employment"), sector.alias("occupation"), F.when(student, "S").otherwise("O").alias("student"),
        F.when(F.col("age") >= DRIVING_AGE, "Y").otherwise("N").alias("license"), F.coalesce("_wz", F.lit(NO_ZONE)).alias("work_zone"),
        F.coalesce("_sz", F.lit(NO_ZONE)).alias("school_zone"), "expansion",
    )


@dataclass(frozen=True)
class TripCodes:
    """Codes of modes, motives and day-start answers; modes with passengers and the code of
    one; repeats: purpose -> its code from the second time on."""

    modes: Codes
    purposes: Codes
    answers: Codes
    driven: Sequence[str] = ()
    passenger: str = "passenger"
    passenger_code: str = "P"
    home: str = "H"
    escort: str = "F"
    other: str = "O"
    repeats: dict = field(default_factory=dict)


def model_trips(
    trips: DataFrame, legs: DataFrame, keys: Sequence[str], codes: TripCodes, back: str, work: Sequence[str], mandatory: Sequence[str], daycare: str, weight: str,
    hh: str, expansion: DataFrame | None = None,
) -> DataFrame:
    """keys, trip (renumbered from 1), start_time, mode, origin_purpose, purpose, origin, dest,
    duration, expansion.

    trips: keys, trip, origin, dest, home, motive, answer, start, main, role, age, is_trip.
    Rows that are no trips are left out. A passenger of a driven mode has a code of their
    own. Home is a purpose only where the zone agrees. The origin's purpose is the
    purpose before, undemoted; the first one's is the answer's. The clock counts on past
    2400 where the day passes midnight. Duration is the legs' minutes. A trip without a
    start is an error.
    """
    t = trips.where(F.coalesce("is_trip", F.lit(True)))
    w = over(keys)
    minutes = legs.groupBy(*keys, "trip").agg(F.sum("minutes").cast("long").alias("duration"))
    t = day_wraps(t, keys, mandatory, back, work).join(minutes, [*keys, "trip"], "left")
    untimed = F.concat(F.lit("no start time: "), *[F.concat(F.col(k).cast("string"), F.lit(" ")) for k in (*keys, "trip")])
    clock = F.when(F.col("start").isNull(), F.raise_error(untimed).cast("long")).otherwise(F.floor(F.col("start") / 60) * 100 + F.col("start") % 60 + 2400 * F.col("days"))
    mode = codes.modes.of(F.col("main"))
    rides = F.coalesce(F.col("main").isin(*codes.driven) & (F.col("role") == codes.passenger), F.lit(False))
    at = lambda code, zone: F.when((code == codes.home) & ~F.col(zone).eqNullSafe(F.col("home")), codes.other).otherwise(code)
    escort = F.coalesce((F.col("motive") == daycare) & (F.col("age") >= ESCORT_AGE), F.lit(False))
    t = t.withColumns({"_p": F.when(escort, codes.escort).otherwise(at(codes.purposes.of(F.col("motive")), "dest")), "_first": at(codes.answers.of(F.col("answer")), "origin")})
    t = t.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("trip")))
    demoted = F.col("_p")
    for purpose, again in codes.repeats.items():
        demoted = F.when((F.col("_p") == purpose) & (F.col("_nth") > 1), again).otherwise(demoted)
    t = t.withColumns(
        {
            "start_time": clock.cast("long"), "mode": F.when(rides, codes.passenger_code).otherwise(mode), "origin_purpose": F.coalesce(F.lag("_p").over(w), "_first"), "purpose": demoted,
            "_number": F.row_number().over(w).cast("long"),
        }
    )
    t = _weighted(t, weight, expansion, hh)
    return t.select(*keys, F.col("_number").alias("trip"), "start_time", "mode", "origin_purpose", "purpose", "origin", "dest", "duration", "expansion")


@dataclass(frozen=True)
class Field:
    """A column of a contract: dtype int, float or str; sentinels are allowed beside domain
    and range; a zone is a positive whole number."""

    dtype: str = "str"
    required: bool = True
    domain: Sequence | None = None
    range: tuple[float | None, float | None] = (None, None)
    sentinels: Sequence = ()
    zone: bool = False


def check_contract(df: DataFrame, fields: dict[str, Field], key: Sequence[str]) -> DataFrame:
    """(problem, rows): missing and extra columns, repeated keys, nulls, values outside the
    domain, that are not whole numbers, below or above the range, and zones that are none;
    by one aggregate over the rows and one over the keys."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    lost = [(f"missing:{c}", None) for c, f in fields.items() if f.required and c not in kinds]
    extra = [(f"extra:{c}", None) for c in df.columns if c not in fields]
    checks: dict[str, Column] = {}
    for c, f in fields.items():
        if c not in kinds:
            continue
        x = F.col(f"`{c}`")
        spared = x.cast("string").isin(*[str(s) for s in f.sentinels]) if f.sentinels else F.lit(False)
        if f.required:
            checks[f"null:{c}"] = x.isNull()
        if f.domain is not None:
            checks[f"domain:{c}"] = ~x.cast("string").isin(*[str(v) for v in f.domain]) & ~spared
        numeric = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        if f.dtype in ("int", "float") and not numeric:
            checks[f"not_numeric:{c}"] = x.isNotNull()
        elif f.dtype == "int" and kinds[c] in ("float", "double") or kinds[c].startswith("decimal") and f.dtype == "int":
            checks[f"not_whole:{c}"] = x != F.floor(x)
        if f.zone and numeric:
            checks[f"zone:{c}"] = (x <= 0) & ~spared
        elif numeric:
            lo, hi = f.range
            if lo is not None:
                checks[f"below:{c}"] = (x < lo) & ~spared
            if hi is not None:
                checks[f"above:{c}"] = (x > hi) & ~spared
    out = spark.createDataFrame([(p, 1) for p, _ in lost + extra], "problem string, rows long")
    if checks:
        wide = df.agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in checks.items()])
        out = out.unionByName(wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("rows")) for n in checks]))))
    if all(k in kinds for k in key):
        twice = df.groupBy(*key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows"))
        out = out.unionByName(twice.select(F.lit("duplicate_key").alias("problem"), "rows"))
    return out.where("rows > 0")


def check_invariants(households: DataFrame, people: DataFrame, trips: DataFrame, hh: str, person: Sequence[str], none: str = "O", home: str = "H", demoted: Sequence[str] = ("R", "C")) -> DataFrame:
    """(invariant, broken): household numbers dense from 0, sector without work and work
    without sector, minutes past 59, demoted codes as origins, trips from home to home,
    chains that do not begin at 1 or have gaps, households smaller than their members, people
    without household and trips without person."""
    count = lambda df, name, test: df.agg(F.count(F.when(test, 1)).alias("broken")).select(F.lit(name).alias("invariant"), "broken")
    dense = households.agg(((F.min(hh) != 0) | (F.max(hh) != F.count("*") - 1) | (F.count_distinct(hh) != F.count("*"))).alias("bad"))
    numbers = trips.groupBy(*person).agg(F.min("trip").alias("lo"), F.max("trip").alias("hi"), F.count("*").alias("n"), F.count_distinct("trip").alias("k"))
    members = people.groupBy(hh).agg(F.count("*").alias("_members"))
    parts = [
        dense.select(F.lit("ids_not_dense").alias("invariant"), F.coalesce(F.col("bad"), F.lit(False)).cast("long").alias("broken")),
        count(people, "work_and_sector_differ", (F.col("employment") == none) != (F.col("occupation") == none)),
        count(trips, "minutes_past_59", F.col("start_time") % 100 >= 60), count(trips, "demoted_origin", F.col("origin_purpose").isin(*demoted)),
        count(trips, "home_to_home", (F.col("origin_purpose") == home) & (F.col("purpose") == home)), count(numbers, "first_not_1", F.col("lo") != 1),
        count(numbers, "gaps", (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("k") != F.col("n"))),
        count(households.join(members, hh), "smaller_than_members", F.col("persons") < F.col("_members")),
        people.join(households.select(hh), hh, "left_anti").agg(F.count("*").alias("broken")).select(F.lit("people_without_household").alias("invariant"), "broken"),
        trips.join(people.select(*person), list(person), "left_anti").agg(F.count("*").alias("broken")).select(F.lit("trips_without_person").alias("invariant"), "broken"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_numbers(df: DataFrame, columns: Sequence[str], sentinels: dict[str, float] | None = None, weight: str | None = None) -> DataFrame:
    """(column, distinct, low, median, high, nulls, sentinel_rows, total): low, median and
    high leave the sentinel out; total is the sum of the weight column, null for others.
    Medians come from value counts and sums over cells of the range, not from one task."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.select(told.alias("t")).select("t.*")
    odd = F.lit(None).cast("double")
    for c, v in (sentinels or {}).items():
        odd = F.when(F.col("column") == c, float(v)).otherwise(odd)
    long = long.withColumn("odd", F.coalesce(F.col("x") == odd, F.lit(False)))
    counts = long.groupBy("column", "x", "odd").agg(F.count("*").alias("n"))
    plain = F.when(~F.col("odd"), F.col("x"))
    facts = counts.groupBy("column").agg(
        F.count("x").alias("distinct"), F.min(plain).alias("low"), F.max(plain).alias("high"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("odd"), F.col("n"))), F.lit(0)).alias("sentinel_rows"), F.sum(F.col("x") * F.col("n")).alias("_sum"),
    )
    middle = medians(long.where("NOT odd"), ["column"], "x")
    total = F.when(F.col("column") == F.lit(weight), F.col("_sum")) if weight else F.lit(None).cast("double")
    return facts.join(middle, "column", "left").select("column", "distinct", "low", "median", "high", "nulls", "sentinel_rows", total.alias("total"))


def profile_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, code, rows) of coded columns."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("code")) for c in columns]))
    return df.select(told.alias("t")).select("t.*").groupBy("column", "code").agg(F.count("*").alias("rows"))
