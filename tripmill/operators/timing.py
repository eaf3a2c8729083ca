"""Missing and mistyped start times: donors, placement, hour edits, least movement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import found_by_workers, stage

from .chains import day_wraps, slide_to_arrival

#: Groups of donors at most, donors that a group should have, donors of a group that one task
#: looks at, and pairs of cells that it compares at once.
GROUPS, GROUP_LEAST, GROUP_ROWS, PAIRS = 4_096, 64, 65_536, 1 << 18

#: Hours added to a start, cost, first and last hour of the start it applies to.
HOUR_EDITS = ((12, 1.0, 0, 11), (-12, 1.1, 17, 23), (-10, 1.2, 15, 19), (10, 1.5, 0, 9), (2, 2.0, 10, 19))
MOST_COST = 6.0
#: Fixed values, in minutes: tolerance of an overlap, the hour before which a return from work
#: is the next morning's, an early first start and the long stay after it, a long errand.
TOLERANCE, NIGHT_RETURN, EARLY_START, EARLY_STAY, LONG_ERRAND = 15, 600, 300, 480, 720


def _groups(pool: DataFrame, same: dict[str, float], numeric: dict[str, float]) -> tuple[DataFrame, pd.DataFrame]:
    """(pool with its group `_g`, table of groups): donors by category tuple and bands of
    their numbers, with the range of each number, GROUPS groups at most.

    Categories join the tuple by falling weight as long as the groups allow; the bands are
    cut at quantiles, as many as then fit. Whatever is left out only widens the bounds.
    """
    order = sorted(same, key=lambda c: -same[c])
    sizes = pool.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.struct(*[f"_{c}" for c in order[: k + 1]])).alias(f"t{k}") for k in range(len(order))]).first()
    tuples = [c for k, c in enumerate(order) if sizes[f"t{k}"] * 1.2 <= GROUPS]
    tuples = tuples[: next((k for k, c in enumerate(order) if c not in tuples), len(order))]
    kinds = max(1.0, sizes[f"t{len(tuples) - 1}"] * 1.2) if tuples else 1.0
    wanted = max(1.0, min(GROUPS, sizes["n"] / GROUP_LEAST) / kinds)
    bands = int(wanted ** (1 / len(numeric))) if numeric else 1
    by = [F.col(f"_{c}").alias(f"_c_{c}") for c in tuples]
    if bands > 1:
        cuts = pool.agg(*[F.percentile_approx(f"_{c}", [j / bands for j in range(1, bands)]).alias(c) for c in numeric]).first()
        band = lambda c: F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts[c])))), lambda e: e < F.col(f"_{c}")))
        by += [band(c).alias(f"_b_{c}") for c in numeric]
    names = [f"_c_{c}" for c in tuples] + ([f"_b_{c}" for c in numeric] if bands > 1 else [])
    banded = pool.select("*", *by)
    ends = [x for c in numeric for x in (F.min(f"_{c}").alias(f"_lo_{c}"), F.max(f"_{c}").alias(f"_hi_{c}"))]
    grouped = banded.groupBy(*names) if names else banded.groupBy()
    table = grouped.agg(F.count("*").alias("_size"), *ends).toPandas().reset_index(names="_g")
    table = table[table["_size"] > 0]
    table["_salts"] = -(-table["_size"] // GROUP_ROWS)
    spark = pool.sparkSession
    if table.empty:
        return banded.withColumns({"_g": F.lit(0), "_salt": F.lit(0)}).drop(*names), table
    small = spark.createDataFrame(table[["_g", "_salts", *names]].astype({"_g": "int64", "_salts": "int64"}))
    placed = banded.join(F.broadcast(small), names) if names else banded.crossJoin(F.broadcast(small))
    return placed.withColumn("_salt", F.pmod(F.xxhash64(*[f"_{c}" for c in (*same, *numeric)]), F.col("_salts"))).drop("_salts", *names), table


def _visits(kinds: DataFrame, table: pd.DataFrame, same: dict[str, float], numeric: dict[str, float], k: int) -> DataFrame:
    """(_q, features, _far, _g, _salt): the groups that each target cell (_q) must look at:
    those whose bound is not above `_far`, a distance that k donors are known not to exceed;
    where kinds has none yet, those of the least bounds that together hold k donors."""
    context = kinds.sparkSession.sparkContext
    told, further = context.broadcast(table), "_far" in kinds.columns
    # few rows, much work each: a number of tasks that is not coalesced
    kinds = kinds.repartition(_tasks(kinds), "_q")
    given = ["_q", *[f"_{c}" for c in (*same, *numeric)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = told.value
        size, salts, ids = (t[c].to_numpy(np.int64) for c in ("_size", "_salts", "_g"))
        for batch in batches:
            for lo in range(0, len(batch), 256):
                q = batch.iloc[lo : lo + 256]
                bound = np.zeros((len(q), len(t)))
                for c, weight in same.items():
                    if f"_c_{c}" in t:
                        bound += weight * (q[f"_{c}"].to_numpy(np.int64)[:, None] != t[f"_c_{c}"].to_numpy(np.int64)[None, :])
                for c, weight in numeric.items():
                    x = q[f"_{c}"].to_numpy(float)[:, None]
                    bound += weight * np.fmax(np.fmax(t[f"_lo_{c}"].to_numpy(float) - x, x - t[f"_hi_{c}"].to_numpy(float)), 0)
                if further:
                    far = q["_far"].to_numpy(float)
                    chosen = bound <= far[:, None] + 1e-9
                else:
                    far, chosen = np.full(len(q), np.inf), np.zeros(bound.shape, bool)
                    near = np.argsort(bound, axis=1, kind="stable")
                    held = np.cumsum(size[near], axis=1)
                    np.put_along_axis(chosen, near, np.hstack([np.ones((len(q), 1), bool), held[:, :-1] < k]), 1)
                row, group = np.nonzero(chosen)
                times = salts[group]
                row, group = np.repeat(row, times), np.repeat(group, times)
                salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield q.iloc[row][given].assign(_far=far[row], _g=ids[group], _salt=salt)

    schema = ", ".join(["_q long", *(f"`_{c}` long" for c in same), *(f"`_{c}` double" for c in numeric), "_far double, _g long, _salt long"])
    return kinds.mapInPandas(run, schema)


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rounded(x: np.ndarray) -> np.ndarray:
    """x to nine places as Spark rounds: halves of the written number away from zero."""
    whole = np.abs(x) >= 1e8  # no places left to round
    y = np.where(whole, 0.0, x) * 1e9
    out = np.where(whole, x, np.rint(y) / 1e9)
    for i in np.flatnonzero(~whole & ((np.abs(y - np.floor(y) - 0.5) < 0.01) | (np.abs(y) > 2.0**43))):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _nearest_of(donors: list[np.ndarray], targets: list[np.ndarray], far: np.ndarray, weights: list[float], categories: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target's position, distance, donor), in this order, of the k nearest donors of each
    target, none farther than `far`. donors: a column for each feature (the first of them
    categories) and their ids; targets: the features. Distances are taken between cells."""
    order = np.lexsort((donors[-1], *donors[-2::-1]))
    who, features = donors[-1][order], [c[order] for c in donors[:-1]]
    new = np.ones(len(who), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in features]) if features else False
    first = np.flatnonzero(new)
    held = np.diff(np.append(first, len(who)))
    cells = [c[first] for c in features]
    # what all cells share is taken once for a target
    cells = [c[:1] if (c == c[0]).all() else c for c in cells]
    most, step, out = min(k, len(first)), max(1, PAIRS // len(first)), []
    for lo in range(0, len(far), step):
        end = far[lo : lo + step]
        d = np.zeros((len(end), 1))
        for n, (c, q, weight) in enumerate(zip(cells, targets, weights)):
            q = q[lo : lo + step, None]
            d = d + (np.where(q != c, weight, 0.0) if n < categories else weight * np.abs(q - c))
        d = np.broadcast_to(np.where(np.isnan(d), np.inf, d), (len(end), len(first)))
        near = np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(first) else np.broadcast_to(np.arange(most), d.shape)
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
        enough = np.cumsum(held[near], axis=1) >= k
        last = np.take_along_axis(d, near, 1)[np.arange(len(end)), np.argmax(enough, axis=1)]
        # rounding moves a distance by less than the margin
        row, cell = np.nonzero(d <= (np.minimum(np.where(enough[:, -1], last, np.inf), end) + 2e-9)[:, None])
        times = held[cell]
        at = np.arange(times.sum()) + np.repeat(first[cell] - np.cumsum(times) + times, times)
        distance, row, donor = np.repeat(rounded(d[row, cell]), times), np.repeat(row, times), who[at]
        order = np.lexsort((donor, distance, row))
        order = order[distance[order] <= end[row[order]]]
        sorted_row = row[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_row, sorted_row) < k]
        out.append((row[order] + lo, distance[order], donor[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _met(visits: DataFrame, sides: DataFrame, same: dict[str, float], numeric: dict[str, float], k: int) -> DataFrame:
    """(_q, _near): of each visit the k nearest donors of the group (distance, donor), in order.
    The rows of a group come to one task, donors first, and its targets pass by in batches."""
    names, weights = [f"_{c}" for c in (*same, *numeric)], [float(w) for w in (*same.values(), *numeric.values())]
    rows = sides.select("_g", "_salt", F.lit(0).alias("_side"), F.col("_d").alias("_id"), F.lit(0.0).alias("_far"), *names)
    rows = rows.unionByName(visits.select("_g", "_salt", F.lit(1).alias("_side"), F.col("_q").alias("_id"), "_far", *names))
    rows = rows.repartition(_tasks(visits), "_g", "_salt").sortWithinPartitions("_g", "_salt", "_side")
    found_by_workers(visits.sparkSession)
    found_type = pa.struct([("far", pa.float64()), ("who", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, donors, whole = None, [], None
        for batch in batches:
            g, salt, side, ids, far, *features = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(g):
                continue
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])])
            asked, near = [], []
            for i, j in zip(cuts, np.append(cuts[1:], len(g))):
                if group != (g[i], salt[i]):
                    group, donors, whole = (g[i], salt[i]), [], None
                if not side[i]:
                    donors.append([*(c[i:j] for c in features), ids[i:j]])
                    continue
                if whole is None:
                    whole = [np.concatenate(c) for c in zip(*donors)]
                row, distance, who = _nearest_of(whole, [c[i:j] for c in features], far[i:j], weights, len(same), k)
                asked.append(ids[i:j][row])
                near.append((distance, who))
            if not asked or not len(who_asked := np.concatenate(asked)):
                continue
            distance, who = (np.concatenate(x) for x in zip(*near))
            starts = np.flatnonzero(np.r_[True, who_asked[1:] != who_asked[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(who_asked)), pa.int32()), pa.StructArray.from_arrays([pa.array(distance), pa.array(who)], fields=list(found_type)))
            yield pa.RecordBatch.from_arrays([pa.array(who_asked[starts]), lists], names=["_q", "_near"])

    return rows.mapInArrow(run, "_q long, _near array<struct<far: double, who: long>>")


def nearest_by_cell(
    targets: DataFrame, donors: DataFrame, key: str, donor: str, same: dict[str, float], numeric: dict[str, float], k: int = 30, report: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """(asked, found): asked (key, _q) names each target's cell, found (_q, donor, distance)
    has the donors of a cell once, as nearest_donors() describes them."""
    names = [*same, *numeric]

    def cells(df: DataFrame, own: str, name: str, none: int) -> DataFrame:
        codes = [F.when(F.col(c).isNull(), none).otherwise(F.xxhash64(c)).alias(f"_{c}") for c in same]
        numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_{c}") for c in numeric]
        return df.select(F.col(own).cast("long").alias(name), *codes, *numbers)

    features = [f"_{c}" for c in names]
    asked = cells(targets, key, "_t", -1)
    first = Window.partitionBy(*features).orderBy("_d")
    pool = stage(cells(donors, donor, "_d", -2).where("_d IS NOT NULL").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"))
    sides, table = _groups(pool, same, numeric)
    # written, so that a cell keeps its number
    kinds = stage(asked.select(*features).distinct().withColumn("_q", F.monotonically_increasing_id()))

    def nearest(visits: DataFrame) -> DataFrame:
        return _met(visits, sides, same, numeric, k).groupBy("_q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))

    early = _visits(kinds, table, same, numeric, k)
    far = F.when(F.size("_near") >= k, F.get("_near", F.lit(k - 1))["far"]).otherwise(F.lit(float("inf")))
    more = _visits(kinds.join(nearest(early).select("_q", far.alias("_far")), "_q"), table, same, numeric, k)
    if report is not None:
        sizes = sides.groupBy("_g", "_salt").agg(F.count("*").alias("n"))
        seen = [v.join(sizes, ["_g", "_salt"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for v in (early, more)]
        ordered = [_met(v, sides, same, numeric, k).agg(F.coalesce(F.sum(F.size("_near")), F.lit(0))).first()[0] for v in (early, more)]
        report |= {"compared": sum(seen), "ordered": sum(ordered), "all": kinds.count() * pool.count(), "groups": len(table)}
    found = nearest(more).select("_q", F.inline("_near")).select("_q", F.col("who").alias(donor), F.col("far").alias("distance"))
    return asked.join(kinds, features).select(F.col("_t").alias(key), "_q"), found


def nearest_donors(
    targets: DataFrame, donors: DataFrame, key: str, donor: str, same: dict[str, float], numeric: dict[str, float], k: int = 30, report: dict | None = None
) -> DataFrame:
    """(key, donor, distance): the k donors of each target by a mixed distance, ties to the
    smallest donor: the weights of the columns of `same` that differ, plus weight times
    the absolute difference of those of `numeric`. A null numeric value counts as 0; a
    null category differs from every value.

    Exact, without comparing all pairs. Rows of equal features are one cell: each target
    cell is searched for once, and of a donor cell only the k smallest donors can be
    chosen. Donors are grouped by categories and bands of their numbers, and a group's
    ranges bound the distance to all of it from below. A target cell first looks at the
    groups of the least bounds that hold k donors; the k-th distance among them is an
    upper limit, so only groups whose bound is not above it are looked at in the end. Large
    groups are dealt over tasks. A group hands on k donors of a target at most, taken from
    its cells in arrays. report, if given, receives the pairs within the groups looked at, those
    handed on and those that there are (more passes).
    """
    asked, found = nearest_by_cell(targets, donors, key, donor, same, numeric, k, report)
    return asked.join(found, "_q").drop("_q")


def knn_impute(near: DataFrame, donors: DataFrame, key: str, donor: str, motive: str, start: str, duration: str) -> DataFrame:
    """(key, motive, start, duration, votes): the motive of most of the nearest donors (ties
    to the least summed distance, then the smallest value), and the median start and
    duration (0 at least) of the donors with that motive."""
    voters = near.join(donors.select(donor, motive, start, duration), donor)
    per = voters.groupBy(key, motive).agg(
        F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("far"), F.median(start).alias(start),
        F.median(F.greatest(F.col(duration), F.lit(0))).alias(duration),
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "far", motive, start, duration))
    return per.groupBy(key).agg(best.alias("b")).select(key, f"b.{motive}", f"b.{start}", f"b.{duration}", (-F.col("b.n")).alias("votes"))


def place_untimed(df: DataFrame, keys: Sequence[str], start: str = "start", minutes: str = "minutes", duration: str = "duration") -> DataFrame:
    """(keys, trip, start, placed): a missing start is set from the trip after it, so that
    the stay between them lasts `duration`, but not before the recorded arrival of the
    trip before nor too late to arrive. One fold from the last trip back fills whole runs;
    what no timed trip follows stays null."""
    w = Window.partitionBy(*keys).orderBy("trip")
    row = F.struct("trip", F.col(start).alias("s"), F.col(minutes).alias("m"), F.col(duration).alias("d"), F.col("_arrival").alias("a"))
    trips = F.sort_array(F.collect_list(row), asc=False)
    empty = F.struct(F.lit(None).cast("long").alias("next"), F.array().cast("array<struct<trip:bigint,s:bigint,placed:bigint>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        latest = state["next"] - t["m"]
        guess = F.least(F.greatest(latest - t["d"], t["a"]), latest)
        placed = F.coalesce(t["s"], F.when(state["next"].isNotNull(), guess)).cast("long")
        made = F.struct(t["trip"].cast("long").alias("trip"), t["s"].cast("long").alias("s"), placed.alias("placed"))
        return F.struct(placed.alias("next"), F.concat(state["out"], F.array(made)).alias("out"))

    arrival = F.lag(F.col(start) + F.col(minutes)).over(w)
    folded = df.withColumn("_arrival", arrival).groupBy(*keys).agg(trips.alias("_t"))
    return folded.select(*keys, F.inline(F.aggregate("_t", empty, step, lambda s: s["out"]))).withColumnRenamed("s", start)


def hour_edits(
    starts: Sequence[float], minutes: Sequence[float], stays: Sequence[float], tolerance: float = TOLERANCE, night: Sequence = (),
    errand: Sequence = (), locked: Sequence = (), early: bool = False, menu: Sequence[tuple] = HOUR_EDITS,
) -> list[int] | None:
    """Hours to add to each start at the least total cost so that the day is feasible; None
    if no or several choices have that cost.

    Feasible: no trip leaves earlier than the previous arrival less tolerance, or it leaves
    the next morning, between two unedited trips; next to an edit a mandatory activity
    (one with a stay) lasts that stay; no mandatory trip follows a night and the day ends
    within 24 hours of its first start; nobody is LONG_ERRAND or more at an errand; with
    early, no first start before EARLY_START with EARLY_STAY or more behind it. Locked
    trips keep their start.

    A trip's choice bears only on its neighbours, the first start and whether a night has
    passed, so the cost of each choice follows from the choices of the trip before: work
    grows with the length of the chain, which therefore needs no bound.
    """
    if not len(starts):
        return []
    at_i = lambda flags, i: bool(len(flags) and flags[i])

    def options(i: int) -> list[tuple[int, float]]:
        h0 = int(starts[i]) // 60
        moves = [] if at_i(locked, i) else [(h, c) for h, c, lo, hi in menu if lo <= h0 <= hi]
        return [(h, c) for h, c in [(0, 0.0), *moves] if 0 <= starts[i] + 60 * h < 1440]

    done: list[tuple[float, int, list[int]]] = []  # cost, ways, hours
    for h0, c0 in options(0):
        first = starts[0] + 60 * h0
        layer = {(h0, False): (c0, 1, [h0])}
        for i in range(1, len(starts)):
            after: dict[tuple[int, bool], tuple[float, int, list[int]]] = {}
            for (hp, passed), (cost, ways, hours) in layer.items():
                before = starts[i - 1] + 60 * hp
                arrival = before + minutes[i - 1]
                for h, c in options(i):
                    at, edited = starts[i] + 60 * h, bool(h or hp)
                    over = not edited and before >= 1080 and (at <= 360 or (at_i(night, i) and at < NIGHT_RETURN))
                    late = at + 1440 * over
                    if (
                        (at < arrival - tolerance and not over)
                        or (edited and stays[i - 1] > 0 and at < arrival + stays[i - 1])
                        or (passed and stays[i] > 0)
                        or (at_i(errand, i - 1) and late - arrival >= LONG_ERRAND)
                        or late + 1440 * passed - first >= 1440
                        or (early and i == 1 and before < EARLY_START and at - arrival >= EARLY_STAY)
                        or round(cost + c, 6) > MOST_COST
                    ):
                        continue
                    state, new = (h, passed or over), (round(cost + c, 6), ways, [*hours, h])
                    old = after.get(state)
                    if old is None or new[0] < old[0]:
                        after[state] = new
                    elif new[0] == old[0]:
                        after[state] = (old[0], 2, old[2])
            layer = after
        done += layer.values()
    low = min((x[0] for x in done), default=None)
    best = [x for x in done if x[0] == low]
    return best[0][2] if sum(x[1] for x in best) == 1 else None


def day_edits(starts, minutes, stays, night, errand, home_next, locked, activity) -> list[int] | None:
    """hour_edits() of a day that needs them: an infeasible one, one that begins before
    EARLY_START with a long stay, or, with the half-day edit back alone, one that stays
    LONG_ERRAND or more at an errand before a return."""
    flags = [bool(x) for x in night], [bool(x) for x in errand], [bool(x) for x in locked]
    n, early = len(starts), bool(len(activity) and activity[0])
    plain = hour_edits(starts, minutes, stays, TOLERANCE, flags[0], (), (), False, ())
    early_stay = early and n > 1 and starts[0] < EARLY_START and starts[1] - starts[0] - minutes[0] >= EARLY_STAY
    menu = HOUR_EDITS
    if plain is not None and not early_stay:
        if not any(errand[i] and home_next[i] and starts[i + 1] - starts[i] - minutes[i] >= LONG_ERRAND for i in range(n - 1)):
            return None
        menu = [e for e in HOUR_EDITS if e[0] == -12]
    return hour_edits(starts, minutes, stays, TOLERANCE, *flags, early, menu)


def least_movement(starts: Sequence[float], minutes: Sequence[float], away: Sequence = ()) -> list[int]:
    """Starts from midnight on with the least total movement such that each trip leaves when
    the previous arrives or later; of these the one that moves the fewest trips, then
    leaves the fewest stays of no minutes after a trip that ends away from home (`away`),
    then moves the fewest minutes earlier.

    Starts less the minutes before them must not fall, and some best choice takes only
    such values or midnight, so it is found along the sorted values.
    """
    before = np.concatenate([[0], np.cumsum(minutes)[:-1]]) if len(starts) else np.zeros(0)
    y = [int(v) for v in np.asarray(starts, float) - before]
    levels = sorted({0} | {v for v in y if v > 0})
    out_of_home = [bool(away[i]) if len(away) else False for i in range(len(y))]
    back, best = [], [(0, 0, 0, 0)] * len(levels)
    for n, v in enumerate(y):
        under, arg, row, came = None, 0, [], []
        for i, level in enumerate(levels):
            # from a lower level, or from the same one, which is a stay of no minutes
            here = best[i] if n == 0 else (best[i][0], best[i][1], best[i][2] + out_of_home[n - 1], best[i][3])
            choice, at = (here, i) if under is None or here < under else (under, arg)
            row.append((choice[0] + abs(v - level), choice[1] + (level != v), choice[2], choice[3] + max(0, v - level)))
            came.append(at)
            if under is None or best[i] < under:
                under, arg = best[i], i
        best = row
        back.append(came)
    out = []
    i = min(range(len(levels)), key=lambda q: (best[q], q))
    for came, b in zip(reversed(back), reversed(before)):
        out.append(int(levels[i] + b))
        i = came[i]
    return out[::-1]


def _per_chain(df: DataFrame, keys: Sequence[str], fields: dict[str, Column], bad: Column, solve, result: str) -> DataFrame:
    """df plus result: solve over the chains with a timed row for which bad holds; of the
    others Python only sees nulls. Rows go through their chain whole, so nothing is joined."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    item = F.struct(F.col("trip").alias("trip"), *[c.cast("double").alias(n) for n, c in fields.items()], bad.alias("bad"), row.alias("row"))
    by_trip = lambda x, y: F.when(x["trip"] < y["trip"], -1).when(x["trip"] > y["trip"], 1).otherwise(0)
    one = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item), by_trip).alias("_t"))
    complete = F.forall("_t", lambda t: t["s"].isNotNull() & t["m"].isNotNull())
    go = complete & F.exists("_t", lambda t: F.coalesce(t["bad"], F.lit(False)))

    @F.pandas_udf("array<long>")
    def answer(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if parts[0] is None else solve(*parts) for parts in zip(*columns)], dtype=object)

    parts = [F.when(go, F.col("_t").getField(n)) for n in fields]
    rows = one.withColumn("_x", answer(*parts)).select(F.posexplode("_t").alias("_i", "_r"), "_x")
    return rows.select("_r.row.*", F.get("_x", F.col("_i")).alias(result))


def repair_start_hours(
    df: DataFrame, keys: Sequence[str], mandatory: Sequence[str], stay: int = 30, start: str = "start", minutes: str = "minutes",
    motive: str = "motive", back: str | None = None, work: Sequence[str] = (), errands: Sequence[str] = (), locked: str | None = None,
) -> DataFrame:
    """df plus repaired: day_edits() of the days that may need them, with `stay`
    minutes at least at a mandatory activity next to an edit. Days that are feasible, have
    an untimed trip, or have no or several cheapest edits stay. Returns after `work` may be
    the next morning's; `errands` are the activities that nobody spends half a day at."""
    w = Window.partitionBy(*keys).orderBy("trip")
    is_back = F.coalesce(F.col(motive) == F.lit(back), F.lit(False))
    least = F.when(F.col(motive).isin(*mandatory), stay).otherwise(0)
    gap = F.lead(start).over(w) - F.col(start) - F.col(minutes)
    errand = F.coalesce(F.col(motive).isin(*errands), F.lit(False))
    first = F.lag("trip").over(w).isNull() & (F.col(start) < EARLY_START) & (gap >= EARLY_STAY)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    fields = {
        "s": F.col(start), "m": F.col(minutes), "k": least, "n": flag(is_back & F.lag(motive).over(w).isin(*work)), "e": flag(errand),
        "b": flag(F.lead(is_back).over(w)), "l": flag(F.col(locked)) if locked else F.lit(0.0), "a": flag(~is_back & ~F.col(motive).isin(*work)),
    }
    d = df.withColumns({f"_{n}": c for n, c in fields.items()}).withColumn("_bad", (gap < -TOLERANCE) | (errand & (gap >= LONG_ERRAND)) | first)
    out = _per_chain(d, keys, {n: F.col(f"_{n}") for n in fields}, F.col("_bad"), day_edits, "_h")
    repaired = (F.col(start) + 60 * F.coalesce("_h", F.lit(0))).cast("long")
    return out.withColumn("repaired", repaired).drop("_h", "_bad", *[f"_{n}" for n in fields])


def read_start_times(
    df: DataFrame, keys: Sequence[str], mandatory: Sequence[str], back: str, work: Sequence[str] = (), errands: Sequence[str] = (),
    start: str = "start", minutes: str = "minutes", motive: str = "motive", locked: str | None = None,
) -> DataFrame:
    """df with start read: hour edits, the move to the arrival, and both once more, what was
    moved or edited locked, as are the rows of `locked` from the outset (from hour edits);
    `edited` and `slid` mark the rows."""
    out = df.withColumns({"edited": F.lit(False), "slid": F.lit(False)})
    for _ in range(2):
        held = F.col(locked) if locked else F.lit(False)
        marked = out.withColumn("_locked", F.col("edited") | F.col("slid") | held)
        hours = repair_start_hours(marked, keys, mandatory, 30, start, minutes, motive, back, work, errands, "_locked")
        edited = F.col("edited") | ~F.col("repaired").eqNullSafe(F.col(start))
        out = hours.withColumn("edited", edited).withColumn(start, F.col("repaired")).drop("repaired", "_locked")
        wraps = day_wraps(out, keys, mandatory, back, work, start, motive)
        moved = slide_to_arrival(wraps, keys, mandatory, start=start, minutes=minutes, motive=motive)
        slid = F.col("slid") | ~F.col("moved_start").eqNullSafe(F.col(start))
        out = moved.withColumn("slid", slid).withColumn(start, F.col("moved_start")).drop("moved_start", "wraps", "days")
    return out


def isotonic_starts(df: DataFrame, keys: Sequence[str], start: str = "start", minutes: str = "minutes", away: Column | None = None) -> DataFrame:
    """df plus moved_start: least_movement() of each chain; chains that are in order or have
    an untimed trip stay. away: whether a trip ends away from home."""
    w = Window.partitionBy(*keys).orderBy("trip")
    d = df.withColumn("_bad", F.col(start) < F.lag(F.col(start) + F.col(minutes)).over(w))
    ends = F.coalesce(away if away is not None else F.lit(False), F.lit(False)).cast("double")
    out = _per_chain(d, keys, {"s": F.col(start), "m": F.col(minutes), "a": ends}, F.col("_bad"), least_movement, "_s")
    return out.withColumn("moved_start", F.coalesce("_s", F.col(start).cast("long"))).drop("_s", "_bad")
