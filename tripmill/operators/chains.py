"""Rules over the ordered trips of a person's day; row order is authoritative.

Every rule takes the key columns of a chain and its order column and uses windows over
them, so that consecutive rules share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: Sequence[str], order: str = "trip"):
    return Window.partitionBy(*keys).orderBy(order)


def continuous_origins(df: DataFrame, keys: Sequence[str], origin: str = "origin", dest: str = "dest") -> DataFrame:
    """Each origin becomes the destination before it; `moved` marks the changes."""
    before = F.lag(dest).over(over(keys))
    new = F.coalesce(before, F.col(origin))
    return df.withColumn("moved", ~new.eqNullSafe(F.col(origin))).withColumn(origin, new)


def arrivals_home(df: DataFrame, keys: Sequence[str], back: str, motive: str = "motive", dest: str = "dest", home: str = "home") -> DataFrame:
    """A later activity that arrives at the home zone from elsewhere is a return."""
    n = F.row_number().over(over(keys))
    hit = (n > 1) & (F.col(dest) == F.col(home)) & ~F.col("origin").eqNullSafe(F.col(home)) & ~F.col(motive).eqNullSafe(F.lit(back))
    return df.withColumn("arrives", F.coalesce(hit, F.lit(False))).withColumn(motive, F.when(F.col("arrives"), back).otherwise(F.col(motive)))


def at_home_walk(df: DataFrame, keys: Sequence[str], back: str, motive: str = "motive", dest: str = "dest", origin: str = "origin", home: str = "home") -> DataFrame:
    """`non_trip`: a return made while the person already is at home.

    The state before a row is the last known one: at home after a return that reaches
    home, away after an activity, unknown after another return; before all rows it is
    whether the first starts from home.
    """
    w = over(keys)
    signal = F.when(~F.col(motive).eqNullSafe(F.lit(back)), False).when(F.col(dest) == F.col(home), True)
    first = F.first(F.col(origin) == F.col(home)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.coalesce(F.last("_signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_first"))
    out = df.withColumn("_signal", signal).withColumn("_first", first)
    return out.withColumn("non_trip", F.coalesce((F.col(motive) == back) & state, F.lit(False))).drop("_signal", "_first")


def duplicate_returns(df: DataFrame, keys: Sequence[str], back: str, motive: str = "motive", dest: str = "dest", home: str = "home", start: str = "start") -> DataFrame:
    """A row to home without motive, followed by a timed home-to-home return, takes its
    motive and missing time; the follower is dropped."""
    w = over(keys)
    pair = (
        F.col(motive).isNull() & (F.col(dest) == F.col(home)) & ~F.col("origin").eqNullSafe(F.col(home)) & (F.lead(motive).over(w) == back)
        & F.lead(start).over(w).isNotNull() & (F.lead("origin").over(w) == F.col(home)) & (F.lead(dest).over(w) == F.col(home))
    )
    out = df.withColumn("_hit", F.coalesce(pair, F.lit(False)))
    out = out.withColumn("_drop", F.coalesce(F.lag("_hit").over(w), F.lit(False)))
    out = out.withColumn("_m", F.lead(motive).over(w)).withColumn("_s", F.lead(start).over(w))
    fixed = {motive: F.when(F.col("_hit"), F.col("_m")).otherwise(F.col(motive)), start: F.when(F.col("_hit"), F.coalesce(start, "_s")).otherwise(F.col(start))}
    return out.withColumns(fixed).where(~F.col("_drop")).drop("_hit", "_drop", "_m", "_s")


def slide_to_arrival(
    df: DataFrame, keys: Sequence[str], mandatory: Sequence[str] = (), tolerance: int = 15, limit: int = 60, start: str = "start",
    minutes: str = "minutes", motive: str = "motive", wraps: str = "wraps",
) -> DataFrame:
    """df plus moved_start: a start before the running arrival moves to it if
    the shortfall that was recorded is within tolerance, or within limit where the trip
    before is not mandatory; moved starts propagate, a trip that passes midnight (column
    wraps, where there is one) stays. A fold over the ordered trips: the test reads the
    recorded start before, the move the moved one."""
    night = F.coalesce(F.col(wraps), F.lit(False)) if wraps in df.columns else F.lit(False)
    reach = F.when(F.col(motive).isin(*mandatory), tolerance).otherwise(limit)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    item = F.struct("trip", F.col(start).cast("long").alias("s"), F.col(minutes).cast("long").alias("m"), night.alias("w"), reach.alias("r"), whole.alias("row"))
    by_trip = lambda x, y: F.when(x["trip"] < y["trip"], -1).when(x["trip"] > y["trip"], 1).otherwise(0)
    trips = F.array_sort(F.collect_list(item), by_trip)
    empty = F.struct(
        F.lit(None).cast("long").alias("moved_end"), F.lit(None).cast("long").alias("recorded_end"), F.lit(None).cast("int").alias("reach"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(state: Column, t: Column) -> Column:
        short = state["recorded_end"] - t["s"]
        move = (t["s"] < state["moved_end"]) & (short <= state["reach"]) & ~t["w"]
        moved = F.when(F.coalesce(move, F.lit(False)), state["moved_end"]).otherwise(t["s"])
        return F.struct(
            F.coalesce(moved + t["m"], state["moved_end"]).alias("moved_end"),
            F.coalesce(t["s"] + t["m"], state["recorded_end"]).alias("recorded_end"),
            t["r"].alias("reach"),
            F.concat(state["out"], F.array(moved)).alias("out"),
        )

    folded = df.groupBy(*keys).agg(trips.alias("_t")).withColumn("_m", F.aggregate("_t", empty, step, lambda s: s["out"]))
    return folded.select(F.posexplode("_t").alias("_i", "_r"), "_m").select("_r.row.*", F.get("_m", F.col("_i")).alias("moved_start"))


def chain_report(df: DataFrame, keys: Sequence[str], start: str = "start", minutes: str = "minutes", home: str = "home") -> DataFrame:
    """Trips with zone breaks, time disorder, overlaps and ties, and chains that do not
    begin or end at home: one row."""
    w = over(keys)
    last = F.lead("trip").over(w).isNull()
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    marked = df.withColumns(
        {
            "zone_breaks": ~F.lag("dest").over(w).eqNullSafe(F.col("origin")) & (F.lag("trip").over(w).isNotNull()),
            "disorder": F.col(start) < F.lag(start).over(w),
            "overlaps": F.col(start) < F.lag(F.col(start) + F.col(minutes)).over(w),
            "ties": F.col(start) == F.lag(start).over(w),
            "first_away": F.lag("trip").over(w).isNull() & (F.col("origin") != F.col(home)),
            "last_away": last & (F.col("dest") != F.col(home)),
        }
    )
    return marked.agg(F.count("*").alias("trips"), *[n(c) for c in ("zone_breaks", "disorder", "overlaps", "ties", "first_away", "last_away")])


def stay_screens(df: DataFrame, keys: Sequence[str], short: int = 5, start: str = "start", minutes: str = "minutes") -> DataFrame:
    """Stays of each chain: number, zero, negative and short ones, total, and the day's
    length."""
    stay = F.lead(start).over(over(keys)) - (F.col(start) + F.col(minutes))
    s = df.withColumn("_stay", stay)
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return s.groupBy(*keys).agg(
        F.count("_stay").alias("stays"), count(F.col("_stay") == 0).alias("zero_stays"), count(F.col("_stay") < 0).alias("negative_stays"),
        count(F.col("_stay").between(1, short)).alias("short_stays"),
        F.coalesce(F.sum(F.when(F.col("_stay") > 0, F.col("_stay"))), F.lit(0)).alias("stay_minutes"),
        (F.max(F.col(start) + F.col(minutes)) - F.min(start)).alias("day_length"),
    )


def day_wraps(
    df: DataFrame, keys: Sequence[str], mandatory: Sequence[str], back: str | None = None, work: Sequence[str] = (), start: str = "start", motive: str = "motive"
) -> DataFrame:
    """`wraps`: a start that is the next calendar day's, and `days`, how many so far. It is
    by 06:00 after a start from 18:00 on, a return by 06:00 after one from noon on, or a
    return before 10:00 from work begun at 18:00 or later; no mandatory trip may come after
    it, and the day's last start must be less than 24 hours after its first."""
    w = over(keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev, is_return = F.lag(start).over(w), F.coalesce(F.col(motive) == F.lit(back), F.lit(False))
    early = (F.col(start) <= 360) & ((prev >= 1080) | ((prev >= 720) & is_return))
    shift = is_return & F.lag(motive).over(w).isin(*work) & (prev >= 1080) & (F.col(start) < 600)
    later = F.max(F.col(motive).isin(*mandatory).cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing))
    night = F.coalesce(early | shift, F.lit(False)) & (F.coalesce(later, F.lit(0)) == 0)
    out = df.withColumn("_night", night).withColumn("_days", F.sum(F.col("_night").cast("long")).over(w))
    clock = F.col(start) + 1440 * F.col("_days")
    span = F.max(clock).over(whole) - F.first(clock).over(whole)
    out = out.withColumn("wraps", F.col("_night") & F.coalesce(span < 1440, F.lit(False))).drop("_night", "_days")
    return out.withColumn("days", F.sum(F.col("wraps").cast("long")).over(w))


def remaining_issues(df: DataFrame, keys: Sequence[str], back: str, start: str = "start", minutes: str = "minutes") -> DataFrame:
    """`issues`: ';'-joined codes of what is still wrong with a trip."""
    w = over(keys)
    prev_end = F.lag(F.col(start) + F.col(minutes)).over(w)
    tests = {
        "untimed": F.col(start).isNull(), "earlier": F.col(start) < F.lag(start).over(w), "same_minute": F.col(start) == F.lag(start).over(w),
        "overlap": F.col(start) < prev_end, "discontinuous": ~F.lag("dest").over(w).eqNullSafe(F.col("origin")) & F.lag("trip").over(w).isNotNull(),
        "return_elsewhere": (F.col("motive") == back) & (F.col("dest") != F.col("home")),
        "first_away": F.lag("trip").over(w).isNull() & (F.col("origin") != F.col("home")),
        "last_away": F.lead("trip").over(w).isNull() & (F.col("dest") != F.col("home")),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), c) for c, t in tests.items()]))
    return df.withColumn("issues", F.array_join(codes, ";"))


def build_trips(df: DataFrame, keys: Sequence[str], purposes: dict[str, str], home_code: str = "H", repeats: dict[str, str] | None = None) -> DataFrame:
    """Model trips: purpose by motive, home only in the home zone; a repeated purpose is
    demoted; the origin's purpose is the one before, undemoted; StartTime as hhmm."""
    w = over(keys)
    chain = F.coalesce(*[F.when(F.col("motive") == m, p) for m, p in purposes.items()], F.lit("O"))
    purpose = F.when((chain == home_code) & (F.col("dest") != F.col("home")), "O").otherwise(chain)
    out = df.withColumn("_p", purpose)
    nth = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("trip"))
    out = out.withColumn("_nth", nth).withColumn("origin_purpose", F.coalesce(F.lag("_p").over(w), F.lit(home_code)))
    demoted = F.coalesce(*[F.when((F.col("_p") == a) & (F.col("_nth") > 1), b) for a, b in (repeats or {}).items()], F.col("_p"))
    hhmm = (F.floor(F.col("start") / 60) * 100 + F.col("start") % 60).cast("long")
    return out.withColumn("purpose", demoted).withColumn("start_time", hhmm).drop("_p", "_nth")


def recode_returns(df: DataFrame, back: str, motives: dict[int, str], other: str, motive: str = "motive", dest: str = "dest", home: str = "home") -> DataFrame:
    """A return that ends elsewhere takes the motive of its place type, else other."""
    table = F.create_map(*[F.lit(x) for kv in motives.items() for x in kv])
    away = F.col(motive).eqNullSafe(F.lit(back)) & (F.col(dest) != F.col(home))
    return df.withColumn(motive, F.when(away, F.coalesce(table[F.col(dest)], F.lit(other))).otherwise(F.col(motive)))


def returns_copying_origin(df: DataFrame, back: str, motive: str = "motive", origin: str = "origin", dest: str = "dest", home: str = "home") -> DataFrame:
    """A return whose destination repeats its origin, away from home, ends at home."""
    copied = F.col(motive).eqNullSafe(F.lit(back)) & (F.col(dest) == F.col(origin)) & (F.col(origin) != F.col(home))
    return df.withColumn(dest, F.when(copied, F.col(home)).otherwise(F.col(dest)))


def returns_elsewhere(
    df: DataFrame, person: str, back: str, motive: str = "motive", dest: str = "dest", home: str = "home", among: Column | None = None
) -> DataFrame:
    """A return that ends elsewhere takes the person's most common activity at that place
    (ties to the first by value); it stays where there is none. Rows outside `among`
    neither count nor change."""
    among = F.lit(True) if among is None else among
    own = df.where(among).where(~F.col(motive).eqNullSafe(F.lit(back)) & F.col(motive).isNotNull()).groupBy(person, dest, motive).agg(F.count("*").alias("_n"))
    first = own.groupBy(person, dest).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(motive).alias("m"))).alias("_b"))
    away = among & F.col(motive).eqNullSafe(F.lit(back)) & (F.col(dest) != F.col(home))
    out = df.join(first.select(person, dest, F.col("_b.m").alias("_usual")), [person, dest], "left")
    return out.withColumn(motive, F.when(away, F.coalesce("_usual", F.col(motive))).otherwise(F.col(motive))).drop("_usual")


def rotated_first_trips(df: DataFrame, keys: Sequence[str], origin: str = "origin", dest: str = "dest", home: str = "home") -> DataFrame:
    """A first trip from a place to home that is followed by a trip from home is turned
    to home -> place, and the next trip starts at that place; `rotated` marks the turn."""
    w = over(keys)
    turn = F.lag(dest).over(w).isNull() & (F.col(origin) != F.col(home)) & (F.col(dest) == F.col(home)) & (F.lead(origin).over(w) == F.col(home))
    out = df.withColumn("_first", F.row_number().over(w) == 1).withColumn("rotated", F.coalesce(turn & F.col("_first"), F.lit(False)))
    out = out.withColumn("_place", F.when(F.lag("rotated").over(w), F.lag(origin).over(w)))
    new_origin = F.when(F.col("rotated"), F.col(home)).otherwise(F.coalesce("_place", F.col(origin)))
    new_dest = F.when(F.col("rotated"), F.col(origin)).otherwise(F.col(dest))
    return out.withColumns({origin: new_origin, dest: new_dest}).drop("_first", "_place")


def cap_rides_home(df: DataFrame, keys: Sequence[str], back: str, tolerance: int = 15, motive: str = "motive", dest: str = "dest", home: str = "home", start: str = "start", minutes: str = "minutes") -> DataFrame:
    """A return home that arrives over tolerance minutes after the next start lasts up to
    that start, if this leaves half of its minutes at least."""
    gap = F.lead(start).over(over(keys)) - F.col(start)
    late = F.col(motive).eqNullSafe(F.lit(back)) & (F.col(dest) == F.col(home)) & (F.col(minutes) - gap > tolerance) & (gap >= 0.5 * F.col(minutes))
    return df.withColumn(minutes, F.when(F.coalesce(late, F.lit(False)), gap).otherwise(F.col(minutes)))


def trip_features(df: DataFrame, keys: Sequence[str], mandatory: Sequence[str], start: str = "start", minutes: str = "minutes", motive: str = "motive", dest: str = "dest") -> DataFrame:
    """Neighbouring starts, previous arrival, own earlier motive at the destination,
    whether a mandatory trip came before, first flag, log1p of the minutes."""
    w = over(keys)
    there = over([*keys, dest]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(F.col(motive).isin(*mandatory).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns(
        {
            "prev_start": F.lag(start).over(w), "next_start": F.lead(start).over(w), "prev_arrival": F.lag(F.col(start) + F.col(minutes)).over(w),
            "same_place_motive": F.last(motive, ignorenulls=True).over(there), "after_mandatory": F.coalesce(earlier, F.lit(0)) > 0,
            "is_first": F.row_number().over(w) == 1, "log_minutes": F.log1p(F.col(minutes).cast("double")),
        }
    )


def donor_mask(features: DataFrame, slack: int = 15, start: str = "start", minutes: str = "minutes") -> DataFrame:
    """donor: timed, with a timed successor after its arrival, and no earlier than slack
    minutes before the previous arrival. Takes what trip_features returns."""
    stays = F.col("next_start") - F.col(start) - F.col(minutes) >= 0
    after = F.col("prev_arrival").isNull() | (F.col(start) >= F.col("prev_arrival") - slack)
    return features.withColumn("donor", F.coalesce(F.col(start).isNotNull() & stays & after, F.lit(False)))


def spread_minutes(legs: DataFrame, keys: Sequence[str], leg: str, minutes: str, total: str) -> DataFrame:
    """Legs whose minutes add up to total (whole numbers, one at least each), shared by
    their own minutes with the largest remainders first; a null total changes nothing."""
    trip = Window.partitionBy(*keys)
    n, own = F.count("*").over(trip), F.sum(minutes).over(trip)
    out = legs.withColumn("_x", (F.col(total) - n) * F.when(own > 0, F.col(minutes) / own).otherwise(1 / n))
    out = out.withColumn("_f", F.floor(F.round("_x", 9))).withColumn("_r", F.round(F.col("_x") - F.col("_f"), 9))
    left = F.col(total) - n - F.sum("_f").over(trip)
    more = (F.row_number().over(trip.orderBy(F.desc("_r"), leg)) <= left).cast("long")
    return out.withColumn(minutes, F.when(F.col(total).isNotNull(), 1 + F.col("_f") + more).otherwise(F.col(minutes)).cast("long")).drop("_x", "_f", "_r")
