"""What is still wrong with a chain: twenty codes by trip, and screens by person."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import at_home_walk, day_wraps, over
from .companions import companion_checks, companion_links
from .returns import next_morning_returns

#: Fixed values, in minutes: the start that late returns are heaped on, the gaps after which
#: the capture fills a return in, the hour of an early start, half a day, a clock's tolerance.
SENTINEL, DEFAULT_GAPS, EARLY, HALF_DAY, NEAR = 1381, (61, 301), 300, 720, 20
#: Fixed values, in minutes: a short stay at work or school, a long day's work, a long day, a
#: long errand, the hour by which a night shift has come home.
SHORT_WORK, LONG_WORKDAY, LONG_DAY, LONG_ERRAND, NIGHT_RETURN = 30, 840, 1200, 480, 600


@dataclass(frozen=True)
class Labels:
    """Labels and columns that the codes read."""

    back: str
    work: Sequence[str] = ()
    mandatory: Sequence[str] = ()
    escort: Sequence[str] = ()
    daycare: str = ""
    home_kind: str = "home"


def issue_codes(df: DataFrame, household: Sequence[str], person: str, labels: Labels, tolerance: int = 15, no_trip: str | None = None) -> DataFrame:
    """df plus `issues`, the ';'-joined codes of every defect left.

    df: household, person, trip, origin, dest, home, motive, kind (type of the destination),
    answer (type of where the day started), start, minutes, mode, edited (a rule or a hand
    set the start), and no_trip, if given, why a row is no trip ("" if it is one). no_trip_at_home and no_trip_next_morning mark rows that are no trips;
    the others are read over the chain without these: inverted (before the arrival by more
    than tolerance, not overnight), overnight, earlier, same_minute, overlap,
    discontinuous, return_elsewhere, doubtful_kind, first_away, first_other_zone,
    last_away, activity_at_home, daycare, start_2301, gap_61, gap_301, early_start,
    companion_12h and untimed.
    """
    keys, who = [*household, person], labels.back
    if no_trip is None:
        marked = at_home_walk(df, keys, who)
        marked = next_morning_returns(marked, [*keys, "non_trip"], who, labels.work)
        reason = F.when(F.col("non_trip"), "no_trip_at_home").when(F.col("next_morning"), "no_trip_next_morning").otherwise("")
        d = marked.withColumn("_none", reason).drop("non_trip", "next_morning")
    else:
        d = df.withColumn("_none", F.col(no_trip))
    within = [*keys, "_none"]
    d = day_wraps(d, within, labels.mandatory, who, labels.work).drop("days")
    links = companion_checks(
        companion_links(d.where("_none = ''").withColumn("start", F.when(~F.col("edited"), F.col("start"))), household, person, labels.escort, NEAR).drop("via"),
        d.where("_none = '' AND NOT edited"), household, person, NEAR,
    ).where("status = 'half_day'")
    half = links.select(*household, F.explode(F.array(*[F.struct(F.col(f"person_{s}").alias(person), F.col(f"trip_{s}").alias("trip")) for s in "ab"])).alias("_x"))
    half = half.select(*household, F.col(f"_x.{person}").alias(person), F.col("_x.trip").alias("trip")).distinct()
    d = d.join(half.withColumn("_half", F.lit(True)), [*keys, "trip"], "left")

    w = over(within)
    first, last = F.lag("trip").over(w).isNull(), F.lead("trip").over(w).isNull()
    start, prev = F.col("start"), F.lag("start").over(w)
    arrival = F.lag(F.col("start") + F.col("minutes")).over(w)
    is_back = F.col("motive").eqNullSafe(F.lit(who))
    at_home = F.col("dest") == F.col("home")
    inverted = (start < arrival - tolerance) & ~F.col("wraps")
    fine = ~F.coalesce(inverted, F.lit(False))
    was = lambda c: F.lag(c).over(w)
    mirror = (
        (F.col("origin") == was("dest")) & (F.col("dest") == was("origin")) & (F.col("minutes") == was("minutes")) & F.col("mode").eqNullSafe(was("mode"))
        & ~F.col("edited") & ~was("edited")
    )
    from_home = F.col("answer").eqNullSafe(F.lit(labels.home_kind))
    tests: dict[str, Column] = {
        "untimed": start.isNull(), "inverted": inverted, "overnight": F.col("wraps"), "earlier": (start < prev) & fine & ~F.col("wraps"),
        "same_minute": (start == prev) & fine, "overlap": (start > prev) & (start < arrival) & fine,
        "discontinuous": ~first & ~F.col("origin").eqNullSafe(was("dest")), "return_elsewhere": is_back & ~at_home,
        "doubtful_kind": is_back & at_home & (F.col("kind") != labels.home_kind), "first_away": first & ~from_home,
        "first_other_zone": first & from_home & (F.col("origin") != F.col("home")), "last_away": last & ~(is_back & at_home),
        "activity_at_home": ~is_back & (F.col("kind") == labels.home_kind), "daycare": F.col("motive") == labels.daycare,
        "start_2301": (start == SENTINEL) & ~F.col("edited"), **{f"gap_{g}": mirror & (start - prev == g) for g in DEFAULT_GAPS},
        "early_start": first & ~is_back & ~F.coalesce(F.col("motive").isin(*labels.work), F.lit(False)) & (start < EARLY),
        "companion_12h": F.col("_half"),
    }
    codes = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), c) for c, t in tests.items()])), ";")
    out = d.withColumn("issues", F.when(F.col("_none") == "", codes).otherwise(F.col("_none")))
    return out.select(*df.columns, "issues")


def chain_screens(
    df: DataFrame, household: Sequence[str], person: str, labels: Labels, reported: str | None = None
) -> DataFrame:
    """What a consistent chain can still get wrong, by household and person: counts of stays
    of no minutes (all, at work, away from home, work, school and drop-offs), stays under
    half an hour at work or school, minutes at work, the day's length, long errands, an
    early start, a night shift's end, trips that a companion contradicts, a boolean for
    each screen, and `problems`, their sum.

    df: what issue_codes() takes, without the rows that are no trips. reported: column of
    the start as it was told (null if none); without it companions contradict nothing.
    """
    keys = [*household, person]
    d = day_wraps(df, keys, labels.mandatory, labels.back, labels.work)
    w = over(keys)
    at = F.col("start") + 1440 * F.col("days")
    d = d.withColumn("_at", at)
    stay = F.lead("_at").over(w) - F.col("_at") - F.col("minutes")
    d = d.withColumns(
        {"_stay": stay, "_first": F.lag("trip").over(w).isNull(), "_last": F.lead("trip").over(w).isNull(), "_was_work": F.coalesce(F.lag("motive").over(w).isin(*labels.work), F.lit(False))}
    )
    among = lambda *names: F.coalesce(F.col("motive").isin(*names), F.lit(False)) if names else F.lit(False)
    work, must = among(*labels.work), among(*labels.work, *labels.mandatory)
    home = F.col("motive").eqNullSafe(F.lit(labels.back))
    zero = F.col("_stay") == 0
    n = lambda test: F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("long")), F.lit(0))
    some = lambda test: F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False))
    morning = F.col("_last") & home & F.col("_was_work") & (F.col("_at") >= 1440) & (F.col("_at") < 1440 + NIGHT_RETURN)
    out = d.groupBy(*keys).agg(
        n(zero).alias("zero_stays"), n(zero & work).alias("zero_work_stays"), n(must & (F.col("_stay") < SHORT_WORK)).alias("short_work_stays"),
        n(zero & ~home & ~must & ~among(*labels.escort)).alias("zero_away_stays"),
        F.coalesce(F.sum(F.when(work, F.greatest("_stay", F.lit(0)))), F.lit(0)).alias("work_minutes"), (F.max(F.col("_at") + F.col("minutes")) - F.min("_at")).alias("day_minutes"),
        n((F.col("_stay") >= LONG_ERRAND) & ~home & ~must).alias("long_errands"), some(F.col("_first") & ~home & ~work & (F.col("start") < EARLY)).alias("early_start"),
        some(morning).alias("night_shift_end"),
    )
    counts = {"companion_apart_trips": F.lit(0).cast("long"), "companion_12h_trips": F.lit(0).cast("long")}
    if reported is not None:
        links = companion_links(df.withColumn("start", F.col(reported)), household, person, labels.escort, NEAR).drop("via")
        told = companion_checks(links, df.withColumn("start", F.col(reported)), household, person, NEAR).withColumnsRenamed({"status": "_told", "start_a": "_ra", "start_b": "_rb"})
        read = companion_checks(told, df, household, person, NEAR)
        same = F.coalesce(F.col("_told") == "same_entry", F.lit(False))
        flags = F.array(F.when(same & (F.col("status") != "same_entry"), "companion_apart_trips"), F.when(~same & (F.col("status") == "half_day"), "companion_12h_trips"))
        sides = F.explode(F.array(*[F.struct(F.col(f"person_{s}").alias("p"), F.col(f"trip_{s}").alias("t")) for s in "ab"]))
        hit = read.withColumn("_c", F.explode(F.array_compact(flags))).select(*household, "_c", sides.alias("_x")).select(*household, F.col("_x.p").alias(person), "_x.t", "_c").distinct()
        hit = hit.groupBy(*keys).agg(*[F.count_if(F.col("_c") == c).alias(f"_{c}") for c in counts])
        out = out.join(hit, keys, "left")
        counts = {c: F.coalesce(f"_{c}", F.lit(0)) for c in counts}
    out = out.withColumns(counts)
    long_day = F.col("day_minutes") > LONG_DAY
    out = out.withColumns(
        {
            "zero_stay": F.col("zero_stays") > 0, "zero_work": F.col("zero_work_stays") > 0, "short_work": F.col("short_work_stays") > 0,
            "long_workday": F.col("work_minutes") > LONG_WORKDAY, "long_day": F.coalesce(long_day, F.lit(False)), "long_errand": F.col("long_errands") > 0,
            "companion_apart": F.col("companion_apart_trips") > 0, "companion_12h": F.col("companion_12h_trips") > 0,
        }
    )
    worn = (F.col("long_day") & ~F.col("night_shift_end")).cast("long")
    problems = F.col("zero_away_stays") + F.col("short_work_stays") + F.col("early_start").cast("long") + F.col("long_errands") + worn + F.col("companion_apart_trips") + F.col("companion_12h_trips")
    return out.withColumn("problems", problems).drop(*[f"_{c}" for c in ("companion_apart_trips", "companion_12h_trips")])
