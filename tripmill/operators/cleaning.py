"""The ordered composition of the chain rules: one call from recorded to cleaned trips."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.sources.staging import spread, stage

from . import chains, returns, timing


@dataclass(frozen=True)
class ChainRules:
    """The labels that the rules read; every list may be empty."""

    back: str
    other: str
    mandatory: Sequence[str] = ()
    work: Sequence[str] = ()
    errands: Sequence[str] = ()
    daycare: str = ""
    escort: str = ""
    place_motives: dict = field(default_factory=dict)  # destination -> motive of a return that ends there
    night_places: Sequence[str] = ()
    home_answer: str = "home"
    evening: int = 1080
    read_hours: bool = True


CHANGED = ("origin", "dest", "motive", "start", "minutes")


def _step(df: DataFrame, code: str, rule: Callable[[DataFrame], DataFrame], at: Column | None = None) -> DataFrame:
    """rule(df), with code added to `fixes` where it changed the row; rows outside `at` keep
    their values."""
    old = [F.col(c).alias(f"_old_{c}") for c in CHANGED]
    out = rule(df.select("*", *old))
    if at is not None:
        out = out.withColumns({c: F.when(at, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in CHANGED})
    same = [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in CHANGED]
    hit = ~F.forall(F.array(*same), lambda x: x)
    fixes = F.when(hit, F.concat("fixes", F.array(F.lit(code)))).otherwise(F.col("fixes"))
    return out.withColumn("fixes", fixes).select(*df.columns)


def clean_chains(trips: DataFrame, keys: Sequence[str], person: str, rules: ChainRules) -> DataFrame:
    """trips with origin, dest, motive, start and minutes cleaned, plus `fixes` and `issues`,
    the ';'-joined codes of what was changed and of what is still wrong; rows that repeat
    a return are dropped.

    In order: repeated returns; motives and destinations; rows that are no trips (a return
    made at home, or the next morning's) and returns that went elsewhere; then, over the
    chain without those rows, origins and first trips, rides home that run into the next
    trip, start hours and arrivals; last, what is left. trips has keys, trip, origin, dest,
    home, motive, start, minutes, age, and the day-start answer and place types
    (answer, from_type, to_type); other columns go along. The rows that are no trips stay in
    the same plan as chains of their own (the key `no_trip`), so that the windows of most
    rules share one shuffle and nothing is computed twice.
    """
    r, names = rules, [*trips.columns, "fixes"]
    d = trips.withColumn("fixes", F.array().cast("array<string>"))
    walk = lambda x: chains.at_home_walk(x, keys, r.back)
    d = _step(d, "repeated_return", lambda x: chains.duplicate_returns(x, keys, r.back))
    d = _step(d, "motive_of_place", lambda x: chains.recode_returns(x, r.back, r.place_motives, r.back) if r.place_motives else x)
    d = _step(d, "dest_copied", lambda x: chains.returns_copying_origin(x, r.back))
    d = _step(d, "motive_home", lambda x: chains.arrivals_home(x, keys, r.back))
    d = _step(d, "motive_escort", lambda x: returns.age_recode(x, r.daycare, r.escort) if r.daycare else x)

    d = walk(_step(walk(d), "motive_usual", lambda x: chains.returns_elsewhere(x, person, r.back, among=~F.col("non_trip"))).drop("non_trip"))
    d = returns.next_morning_returns(d, [*keys, "non_trip"], r.back, r.work, r.evening)
    reason = F.when(F.col("non_trip"), "no_trip_at_home").when(F.col("next_morning"), "no_trip_next_morning")
    # the rules before and after are many sorts; written here, they are not all held at once
    c = spread(stage(d.select(*names, F.coalesce(reason, F.lit("")).alias("no_trip"))), *keys)
    within, trip = [*keys, "no_trip"], F.col("no_trip") == ""

    c = _step(c, "origin_before", lambda x: chains.continuous_origins(x, within), trip)
    home = lambda x: returns.first_origins_home(x, within, r.back, "answer", r.home_answer, "from_type", "to_type", r.night_places)
    c = _step(c, "origin_home", home, trip)
    c = _step(c, "rotated", lambda x: chains.rotated_first_trips(x, within), trip)
    c = _step(c, "short_return", lambda x: returns.short_returns(x, within, r.back, r.other), trip)
    c = _step(c, "minutes_home", lambda x: chains.cap_rides_home(x, within, r.back), trip)
    if r.read_hours:
        recorded = c.withColumn("_start", F.col("start"))
        c = timing.read_start_times(recorded, within, r.mandatory, r.back, r.work, r.errands)
        code = lambda flag, name: F.when(trip & F.col(flag), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        c = c.withColumn("fixes", F.concat("fixes", code("edited", "hour"), code("slid", "arrival")))
        c = c.withColumn("start", F.when(trip, F.col("start")).otherwise(F.col("_start")))
    else:
        wraps = lambda x: chains.day_wraps(x, within, r.mandatory, r.back, r.work)
        slide = lambda x: chains.slide_to_arrival(wraps(x), within, r.mandatory).withColumn("start", F.col("moved_start"))
        c = _step(c, "arrival", slide, trip)
    c = chains.remaining_issues(c, within, r.back)
    c = c.withColumn("issues", F.when(trip, F.col("issues")).otherwise(F.col("no_trip")))
    return c.select(*names, "issues").withColumn("fixes", F.array_join("fixes", ";"))


def chain_counts(cleaned: DataFrame) -> DataFrame:
    """(kind, code, rows) of the codes of clean_chains()."""
    told = F.array(*[F.struct(F.lit(k).alias("kind"), F.split(k, ";").alias("codes")) for k in ("fixes", "issues")])
    both = cleaned.select(F.inline(told)).select("kind", F.explode("codes").alias("code"))
    return both.where("code <> ''").groupBy("kind", "code").agg(F.count("*").alias("rows"))
