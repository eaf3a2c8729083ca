"""From a recorded survey to cleaned chains: trips and legs through all rules in order.

Two tables go through one plan: the rules read and write the trips; what they set of a
trip's minutes is spread over its legs at the end. A row that is no trip stays, as a chain
of its own, and its values are locked from there on. Zones, place types and the person's
answer to where the day started follow each move. Between the stages the trips are
written, so no plan repeats another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import stage

from . import issues, timing
from .chains import day_wraps, donor_mask, over, slide_to_arrival, spread_minutes, trip_features

#: Minutes of overlap that rounding explains, share of its minutes that a ride
#: home keeps at least, hour of an evening departure to work, age from which daycare is an escort's.
TOLERANCE, KEPT, EVENING, ESCORT_AGE = 15, 0.5, 1080, 12
#: Trips of one occupation to a zone, and share of them, that name its place type.
LEAST_TRIPS, LEAST_SHARE = 5, 0.6


@dataclass(frozen=True)
class SurveyRules:
    """The labels that the rules read. household: its columns, within which the person's day
    is a chain; same and numeric: weights of the features by which donors are compared."""

    back: str
    other: str
    home_kind: str = "home"
    mandatory: Sequence[str] = ()
    work: Sequence[str] = ()
    errands: Sequence[str] = ()
    escort: str = "escort"
    daycare: str = "daycare"
    kind_motives: dict = field(default_factory=dict)
    night_kinds: Sequence[str] = ()
    same: dict = field(default_factory=dict)
    numeric: dict = field(default_factory=lambda: {"log_minutes": 1.0})
    neighbours: int = 30
    impute: bool = True
    read_hours: bool = True


def _fix(df: DataFrame, hit: Column, codes: Sequence[tuple[str, Column | None]], changes: dict[str, Column]) -> DataFrame:
    """df with changes where hit, and the codes (those whose condition held before) noted in fixes."""
    noted = F.array_compact(F.array(F.lit(None).cast("string"), *[F.lit(c) if when is None else F.when(when, c) for c, when in codes]))
    d = df.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_noted": noted})
    new = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}
    new["fixes"] = F.when(F.col("_hit"), F.concat("fixes", "_noted")).otherwise(F.col("fixes"))
    return d.withColumns(new).drop("_hit", "_noted")


def correct_minutes(trips: DataFrame, legs: DataFrame, keys: Sequence[str], corrections: DataFrame) -> DataFrame:
    """trips with the reviewed minutes (keys, trip, before, after) and `corrected`; a
    correction of a trip that is not there, or that has other minutes, is an error."""
    row = [*keys, "trip"]
    own = legs.groupBy(*row).agg(F.sum("minutes").alias("_own"))
    wrong = corrections.join(own, row, "left").where(~F.col("_own").eqNullSafe(F.col("before"))).limit(5).collect()
    if wrong:
        raise ValueError(f"minutes that cannot be corrected: {[r.asDict() for r in wrong]}")
    out = trips.join(corrections.select(*row, F.col("after").alias("_after")), row, "left")
    return out.withColumns({"minutes": F.coalesce("_after", "minutes"), "corrected": F.col("_after").isNotNull()}).drop("_after")


def _votes(near: DataFrame, donors: DataFrame, row: str) -> DataFrame:
    """(row, v_motive, v_kind, v_start, v_stay): the motive of most of the nearest donors, the
    type most of these name, their median start and stay."""
    voters = near.join(donors.select("donor_id", "motive", "kind", "start", "stay"), "donor_id")
    per = voters.groupBy(row, "motive").agg(
        F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("far"), F.median("start").alias("s"), F.median(F.greatest("stay", F.lit(0))).alias("d")
    )
    best = per.groupBy(row).agg(F.min(F.struct((-F.col("n")).alias("n"), "far", "motive", "s", "d")).alias("b"))
    kinds = voters.where("kind IS NOT NULL").groupBy(row, "motive", "kind").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy(row, "motive").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("k")).select(row, F.col("motive").alias("v_motive"), F.col("k.kind").alias("v_kind"))
    flat = best.select(row, F.col("b.motive").alias("v_motive"), F.col("b.s").alias("v_start"), F.col("b.d").alias("v_stay"))
    return flat.join(kinds, [row, "v_motive"], "left")


def impute_untimed(df: DataFrame, keys: Sequence[str], row: str, rules: SurveyRules, passes: int = 20) -> DataFrame:
    """Rows without a motive or a start take the vote of the nearest timed activities; a
    start is placed back from the next trip, after the arrival of the one before. A run of
    such rows is filled from its end, one row in each pass; `imputed` marks the starts.
    Chains without such rows are written once and only read from then on, as donors too."""
    w, chain = over(keys), Window.partitionBy(*keys)
    out = df.withColumn("imputed", F.lit(False))
    columns, done = out.columns, []
    pending = F.col("start").isNull() | F.col("motive").isNull()
    whole = lambda tables: reduce(DataFrame.unionByName, tables)
    while True:
        f = donor_mask(trip_features(out, keys, rules.mandatory)).withColumns(
            {
                "stay": F.col("next_start") - F.col("start") - F.col("minutes"), "next_hour": F.col("next_start") / 60,
                "within_zone": F.col("origin") == F.col("dest"), "from_home": F.col("origin") == F.col("home"),
                "next_is_return": F.lead("motive").over(w).eqNullSafe(F.lit(rules.back)),
                "_later": F.lead("start").over(w).isNull() & F.lead("trip").over(w).isNotNull(), "_open": F.max(pending).over(chain),
            }
        )
        every = stage(f)
        donors = whole([*done, every]).where(F.col("donor") & F.col("motive").isNotNull() & (F.col("motive") != rules.back)).withColumn("donor_id", F.col(row))
        done.append(every.where(~F.col("_open")))
        f = every.where("_open")
        if f.isEmpty():
            return whole(done).select(*columns)
        if len(done) > passes:
            raise ValueError(f"untimed trips left after {passes} passes")
        ready = pending & ~F.col("_later")
        if f.where(ready).isEmpty():
            ready = pending
        if donors.isEmpty():
            raise ValueError("no timed activity to impute from")
        # trips of equal features have the same donors and the same vote
        asked, near = timing.nearest_by_cell(f.where(ready), donors, row, "donor_id", rules.same, rules.numeric, rules.neighbours)
        votes = asked.join(_votes(stage(near), donors, "_q"), "_q").drop("_q")
        d = f.join(votes, row, "left")
        latest = F.col("next_start") - F.col("minutes")
        guess = F.greatest(F.coalesce(latest - F.col("v_stay"), F.col("v_start")), F.col("prev_arrival"))
        placed = F.least(F.greatest(F.round(F.when(latest.isNull(), guess).otherwise(F.least(guess, latest))), F.lit(0)), F.lit(1439)).cast("long")
        voted, bare = F.col("v_motive").isNotNull(), F.col("motive").isNull()
        d = d.withColumn("imputed", F.col("imputed") | (voted & F.col("start").isNull()))
        d = _fix(
            d, voted, [("hour:neighbours", F.col("start").isNull()), ("motive:neighbours", bare)],
            {"start": F.coalesce("start", placed), "kind": F.when(bare, F.col("v_kind")).otherwise(F.col("kind")), "motive": F.coalesce("motive", "v_motive")},
        )
        out = d.select(*columns)


def _lost_block(d: DataFrame, keys: Sequence[str], r: SurveyRules) -> DataFrame:
    """A row without motive from elsewhere to home, followed by a timed return from home to
    home, takes what that row says; the follower is dropped."""
    w = over(keys)
    nxt = lambda c: F.lead(c).over(w)
    home = F.col("home")
    pair = (
        F.col("motive").isNull() & (F.col("origin") != home) & (F.col("dest") == home) & (nxt("motive") == r.back) & (nxt("origin") == home) & (nxt("dest") == home)
        & nxt("start").isNotNull()
    )
    d = d.withColumns({"_pair": F.coalesce(pair, F.lit(False)), "_m": nxt("motive"), "_k": nxt("kind"), "_s": nxt("start")})
    d = d.withColumn("_repeat", F.coalesce(F.lag("_pair").over(w), F.lit(False)))
    d = _fix(d, F.col("_pair"), [("hour:duplicate", F.col("start").isNull()), ("motive:duplicate", None)], {"motive": F.col("_m"), "kind": F.col("_k"), "start": F.coalesce("start", "_s")})
    return d.where(~F.col("_repeat")).drop("_pair", "_m", "_k", "_s", "_repeat")


def _motive_of_kind(kind: Column, r: SurveyRules) -> Column:
    if not r.kind_motives:
        return F.lit(r.other)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in r.kind_motives.items() for x in kv])[kind], F.lit(r.other))


def _motives(d: DataFrame, keys: Sequence[str], r: SurveyRules) -> DataFrame:
    """Motives and destinations that the place contradicts."""
    back, home = F.col("motive").eqNullSafe(F.lit(r.back)), F.col("home")
    d = _fix(d, back & (F.col("dest") != home) & (F.col("kind") != r.home_kind), [("motive:kind", None)], {"motive": _motive_of_kind(F.col("kind"), r)})
    d = _fix(d, back & (F.col("dest") == F.col("origin")) & (F.col("dest") != home), [("dest:copy", None)], {"dest": home, "dest_zone": F.col("home_zone")})
    later = F.lag("trip").over(over(keys)).isNotNull()
    arrives = later & F.col("motive").isNotNull() & ~back & (F.col("kind") == r.home_kind) & (F.col("dest") == home) & (F.col("origin") != home)
    d = _fix(d, arrives, [("motive:home", None)], {"motive": F.lit(r.back)})
    return _fix(d, (F.col("motive") == r.daycare) & (F.col("age") >= ESCORT_AGE), [("motive:daycare", None)], {"motive": F.lit(r.escort)})


def _at_home(d: DataFrame, keys: Sequence[str], r: SurveyRules) -> DataFrame:
    """`_idle`: a return made while the person is at home already."""
    w = over(keys)
    back, reaches = F.col("motive").eqNullSafe(F.lit(r.back)), F.col("dest") == F.col("home")
    d = d.withColumns(
        {
            "_signal": F.when(~back, False).when(reaches, True),
            "_begins": F.first(F.coalesce((F.col("answer") == r.home_kind) & (F.col("origin") == F.col("home")), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    state = F.coalesce(F.last("_signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_begins"))
    return d.withColumn("_idle", back & state).drop("_signal", "_begins")


def _elsewhere(d: DataFrame, keys: Sequence[str], r: SurveyRules) -> DataFrame:
    """A return that went elsewhere takes the motive and type that the day's own trips to that
    place have most often, else those of the day-start answer if the day started there."""
    within = [*keys, "_idle"]
    d = d.withColumn("_from", F.first("origin").over(over(within).rowsBetween(Window.unboundedPreceding, 0)))
    back = F.col("motive").eqNullSafe(F.lit(r.back))
    visits = d.where(~F.col("_idle") & F.col("motive").isNotNull() & ~back).groupBy(*keys, "dest", "motive", "kind").agg(F.count("*").alias("n"))
    per = visits.groupBy(*keys, "dest", "motive").agg(F.sum("n").alias("n"), F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("n"), "kind"))).alias("k"))
    usual = per.groupBy(*keys, "dest").agg(F.min(F.struct((-F.col("n")).alias("n"), "motive", F.col("k.kind").alias("kind"))).alias("u"))
    d = d.join(usual, [*keys, "dest"], "left")
    target = ~F.col("_idle") & back & (F.col("dest") != F.col("home")) & (F.col("dest") != F.col("origin"))
    started = (F.col("_from") == F.col("dest")) & (F.col("answer") != r.home_kind)
    motive = F.coalesce(F.col("u.motive"), F.when(started, _motive_of_kind(F.col("answer"), r)))
    kind = F.when(F.col("u").isNotNull(), F.col("u.kind")).otherwise(F.col("answer"))
    d = d.withColumn("_motive", motive)
    return _fix(d, target & F.col("_motive").isNotNull(), [("motive:place", None)], {"motive": F.col("_motive"), "kind": kind}).drop("u", "_motive", "_from")


def _next_morning(keys: Sequence[str], r: SurveyRules) -> Column:
    """The last return from the workplace left for in the evening, in a day that opens with a
    return from there."""
    w = over(keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        F.lead("trip").over(w).isNull() & (F.col("motive") == r.back) & (F.col("origin") != F.col("home")) & F.lag("motive").over(w).isin(*r.work)
        & (F.lag("dest").over(w) == F.col("origin")) & (F.lag("start").over(w) >= EVENING) & (F.first("motive").over(whole) == r.back)
        & (F.first("origin").over(whole) == F.col("origin"))
    )


def _origins(d: DataFrame, within: Sequence[str], r: SurveyRules) -> DataFrame:
    """Trips start where the one before ended; the day's first trip where the record allows."""
    w, trip, home = over(within), F.col("no_trip") == "", F.col("home")
    was, nxt = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    d = d.withColumns({"_broken": F.coalesce(trip & was("trip").isNotNull() & (F.col("origin") != was("dest")), F.lit(False)), "_d": was("dest"), "_z": was("dest_zone"), "_m": was("motive")})
    d = d.withColumn("_homeward", F.coalesce((F.col("_m") == r.back) & (F.col("_d") == home), F.lit(False)))
    d = _fix(d, F.col("_broken"), [("origin:home", F.col("_homeward")), ("origin:before", ~F.col("_homeward"))], {"origin": F.col("_d"), "origin_zone": F.col("_z")})

    first = trip & was("trip").isNull()
    activity = ~F.col("motive").eqNullSafe(F.lit(r.back))
    away = first & activity & (F.col("origin") != home)
    copied = away & (F.col("origin") == F.col("dest"))
    other = away & (F.col("origin") != F.col("dest")) & (F.col("dest") != home)
    answered = other & (F.col("answer") == r.home_kind)
    typed = other & (F.col("answer") == F.col("kind")) & ~F.col("answer").isin(*r.night_kinds)
    flags = {"_copied": copied, "_answered": answered, "_typed": typed}
    d = d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    d = _fix(
        d, F.col("_copied") | F.col("_answered") | F.col("_typed"),
        [("origin:copy", F.col("_copied")), ("origin:answer", F.col("_answered")), ("origin:kind", F.col("_typed"))], {"origin": home, "origin_zone": F.col("home_zone")},
    )
    turn = (
        first & activity & (F.col("origin") != home) & (F.col("dest") == home) & (nxt("trip").isNull() | (nxt("origin") == home))
        & (F.col("answer").eqNullSafe(F.lit(r.home_kind)) | F.coalesce((nxt("motive") == r.back) & (nxt("dest") == home), F.lit(False)))
    )
    d = d.withColumn("_rotated", F.coalesce(turn, F.lit(False)))
    d = d.withColumns({"_onward": F.coalesce(was("_rotated"), F.lit(False)), "_place": was("origin"), "_place_zone": was("origin_zone")})
    named = F.coalesce((F.col("kind") == r.home_kind) & (F.col("answer") != r.home_kind), F.lit(False))
    d = _fix(
        d, F.col("_rotated"), [("origin:rotated", None), ("dest:rotated", None), ("kind:rotated", named)],
        {"origin": home, "dest": F.col("origin"), "origin_zone": F.col("home_zone"), "dest_zone": F.col("origin_zone"), "kind": F.when(named, F.col("answer")).otherwise(F.col("kind"))},
    )
    d = _fix(d, F.col("_onward"), [("origin:before", ~F.col("_broken"))], {"origin": F.col("_place"), "origin_zone": F.col("_place_zone")})
    return d.drop("_broken", "_d", "_z", "_m", "_homeward", "_answered", "_onward", "_place", "_place_zone")


def _usual_kind(seen: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name, n, t): the most common type, its trips and all."""
    per = seen.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("b"), F.sum("n").alias("t"))
    return best.select(*keys, F.col("b.kind").alias(name), (-F.col("b.n")).alias("n"), "t")


def _answers(d: DataFrame, keys: Sequence[str], within: Sequence[str], r: SurveyRules) -> DataFrame:
    """The person's answer to where the day started follows a first trip that moved home; a
    day that opens with a return from elsewhere takes the type that the person's, else the
    household's, else enough of the occupation's trips to that place name, else other."""
    chain = Window.partitionBy(*keys)
    moved = F.max(F.col("_copied") | F.col("_typed") | F.col("_rotated")).over(chain)
    d = _fix(d, moved & ~F.col("answer").eqNullSafe(F.lit(r.home_kind)), [("answer:copy", None)], {"answer": F.lit(r.home_kind)}).drop("_copied", "_typed", "_rotated")
    trip, back = F.col("no_trip") == "", F.col("motive").eqNullSafe(F.lit(r.back))
    opens = trip & F.lag("trip").over(over(within)).isNull() & back & (F.col("origin") != F.col("home")) & (F.col("answer") == r.home_kind)
    d = stage(d.withColumn("_opens", F.coalesce(opens, F.lit(False))))
    seen = d.where(trip & ~back & F.col("kind").isNotNull() & (F.col("kind") != r.home_kind)).withColumn("_at", F.col("dest"))
    asked = d.where("_opens").select(*keys, "hh", "occupation", F.col("origin").alias("_at"))
    found = asked.join(_usual_kind(seen, [*keys, "_at"], "_own").drop("n", "t"), [*keys, "_at"], "left").join(_usual_kind(seen, ["hh", "_at"], "_home").drop("n", "t"), ["hh", "_at"], "left")
    job = _usual_kind(seen.where("occupation IS NOT NULL"), ["occupation", "_at"], "_job").where((F.col("t") >= LEAST_TRIPS) & (F.col("n") >= LEAST_SHARE * F.col("t")))
    found = found.join(job.drop("n", "t"), ["occupation", "_at"], "left").select(*keys, F.coalesce("_own", "_home", "_job", F.lit(r.other)).alias("_said"))
    d = d.join(found, list(keys), "left")
    return _fix(d, F.col("_said").isNotNull(), [("answer:return", None)], {"answer": F.col("_said")}).drop("_said", "_opens")


def _short(d: DataFrame, within: Sequence[str], r: SurveyRules) -> DataFrame:
    """A return still away: home, if it is the last trip to a zone nothing else of the day
    touches, else an activity that nothing names."""
    chain = Window.partitionBy(*within)
    target = (F.col("no_trip") == "") & F.col("motive").eqNullSafe(F.lit(r.back)) & (F.col("dest") != F.col("home"))
    times = lambda c: F.size(F.filter(F.collect_list(c).over(chain), lambda z: z == F.col("dest")))
    alone = F.lead("trip").over(over(within)).isNull() & (times("origin") == 0) & (times("dest") == 1)
    d = d.withColumns({"_short": F.coalesce(target, F.lit(False)), "_alone": F.coalesce(alone, F.lit(False))})
    d = _fix(d, F.col("_short") & F.col("_alone"), [("dest:home", None)], {"dest": F.col("home"), "dest_zone": F.col("home_zone")})
    return _fix(d, F.col("_short") & ~F.col("_alone"), [("motive:other", None)], {"motive": F.lit(r.other), "kind": F.lit(r.other)}).drop("_short", "_alone")


def _rides_home(d: DataFrame, within: Sequence[str], r: SurveyRules) -> DataFrame:
    """A ride home that runs past the next departure takes the minutes up to it."""
    w = over(within)
    gap = F.lead("start").over(w) - F.col("start")
    hit = (
        (F.col("no_trip") == "") & (F.col("motive") == r.back) & (F.col("dest") == F.col("home")) & ~F.col("corrected") & ~F.col("imputed") & ~F.lead("imputed").over(w)
        & (gap >= 0) & (F.col("minutes") - gap > TOLERANCE) & (gap >= KEPT * F.col("minutes"))
    )
    d = d.withColumns({"_gap": gap.cast("long"), "_ride": F.coalesce(hit, F.lit(False))})
    return _fix(d, F.col("_ride"), [("minutes:return", None)], {"minutes": F.col("_gap")}).drop("_gap")


def _times(d: DataFrame, within: Sequence[str], r: SurveyRules) -> DataFrame:
    """Start hours and arrivals; imputed starts and rows that are no trips keep theirs."""
    trip = F.col("no_trip") == ""
    d = d.withColumn("_told", F.col("start"))
    if r.read_hours:
        d = timing.read_start_times(d, within, r.mandatory, r.back, r.work, r.errands, locked="imputed")
    else:
        d = slide_to_arrival(day_wraps(d, within, r.mandatory, r.back, r.work), within, r.mandatory, limit=60, tolerance=TOLERANCE)
        d = d.withColumns({"slid": ~F.col("moved_start").eqNullSafe(F.col("start")), "edited": F.lit(False), "start": F.col("moved_start")}).drop("moved_start", "wraps", "days")
    note = lambda flag, code: F.when(trip & F.col(flag), F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    return d.withColumns(
        {
            "fixes": F.concat("fixes", note("edited", "hour:edit"), note("slid", "hour:arrival")), "start": F.when(trip, F.col("start")).otherwise(F.col("_told")),
            "edited": trip & (F.col("edited") | F.col("slid") | F.col("imputed")),
        }
    ).drop("_told", "slid")


def clean_survey(
    trips: DataFrame, legs: DataFrame, keys: Sequence[str], row: str, rules: SurveyRules, household: Sequence[str], person: str, corrections: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(trips, legs) after every rule: trips with `fixes` and `issues`, the ';'-joined codes of
    what was changed and what is still wrong; legs with minutes that add up to the trip's.

    trips: keys (a person's day), trip, row (a unique whole number), hh, origin, dest, home,
    each with its zone (origin_zone, dest_zone, home_zone), motive, kind (place type of the
    destination), answer (place type where the day started, one for a person), start,
    minutes, mode, age, occupation; other columns go along. legs: keys, trip, leg,
    minutes. corrections: (keys, trip, before, after), reviewed minutes. household and
    person: columns within which companions are looked for.

    In order: reviewed minutes; what the questionnaire lost (repeated returns, then
    neighbours); motives and destinations; the rows that are no trips and the returns that
    went elsewhere; origins, first trips and the answers; returns that stop short; rides
    home; start hours and arrivals; what is left.
    """
    r = rules
    d = trips.withColumns({"fixes": F.array().cast("array<string>"), "corrected": F.lit(False), "imputed": F.lit(False)})
    if corrections is not None:
        d = correct_minutes(d, legs, keys, corrections)
        d = _fix(d, F.col("corrected"), [("minutes:review", None)], {})
    d = _lost_block(d, keys, r)
    if r.impute:
        d = impute_untimed(stage(d), keys, row, r)
    d = _at_home(_motives(d, keys, r), keys, r)
    d = stage(_elsewhere(d, keys, r).drop("_idle"))
    d = _at_home(d, keys, r)
    morning = F.coalesce(_next_morning([*keys, "_idle"], r), F.lit(False))
    d = d.withColumn("no_trip", F.when(F.col("_idle"), "no_trip_at_home").when(morning, "no_trip_next_morning").otherwise("")).drop("_idle")
    within = [*keys, "no_trip"]
    d = _answers(_origins(d, within, r), keys, within, r)
    d = stage(_rides_home(_short(d, within, r), within, r))
    d = stage(_times(d, within, r))
    labels = issues.Labels(r.back, r.work, r.mandatory, [r.escort], r.daycare, r.home_kind)
    done = issues.issue_codes(d, household, person, labels, TOLERANCE, no_trip="no_trip")
    changed = d.where("corrected OR _ride").select(*keys, "trip", F.col("minutes").alias("_total"))
    kept = legs.join(d.select(*keys, "trip"), [*keys, "trip"], "left_semi")
    spread = spread_minutes(kept.join(changed, [*keys, "trip"], "left"), [*keys, "trip"], "leg", "minutes", "_total")
    return done.withColumn("fixes", F.array_join("fixes", ";")).select(*trips.columns, "fixes", "issues"), spread.select(*legs.columns)


def clean_counts(cleaned: DataFrame) -> DataFrame:
    """(kind, code, rows, persons) of the codes that clean_survey() notes."""
    told = F.array(*[F.struct(F.lit(k).alias("side"), F.split(k, ";").alias("codes")) for k in ("fixes", "issues")])
    both = cleaned.select("person", F.inline(told)).select("person", "side", F.explode("codes").alias("code")).where("code <> ''")
    per = both.groupBy("side", "code", "person").agg(F.count("*").alias("n"))
    return per.groupBy("side", "code").agg(F.sum("n").alias("rows"), F.count("*").alias("persons"))
