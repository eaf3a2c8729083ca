"""Start-time searches against trying everything."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmill.operators import chains, cleaning, timing

TRIP = st.tuples(st.integers(0, 1439), st.integers(1, 90), st.sampled_from([0, 30]), st.booleans(), st.booleans(), st.sampled_from([False, False, True]))


@settings(max_examples=300, deadline=None)
@given(st.lists(TRIP, max_size=4), st.booleans())
def test_hour_edits_equal_brute_force(chain, early):
    s, m, k, night, errand, locked = ([t[i] for t in chain] for i in range(6))
    options = [[(0, 0.0)] + [(h, c) for h, c, lo, hi in timing.HOUR_EDITS if lo <= x // 60 <= hi and not lock] for x, lock in zip(s, locked)]

    def feasible(hours):
        at = [x + 60 * h for x, h in zip(s, hours)]
        passed = 0
        for i in range(1, len(at)):
            arrival, edited = at[i - 1] + m[i - 1], hours[i] or hours[i - 1]
            over = not edited and at[i - 1] >= 18 * 60 and (at[i] <= 6 * 60 or (night[i] and at[i] < 10 * 60))
            if (at[i] < arrival - 15 and not over) or (edited and k[i - 1] and at[i] < arrival + k[i - 1]) or (passed and k[i]):
                return False
            if errand[i - 1] and at[i] + 1440 * over - arrival >= 720:
                return False
            passed += over
            if at[i] + 1440 * passed - at[0] >= 1440:
                return False
        return all(0 <= x < 1440 for x in at) and not (early and len(at) > 1 and at[0] < 300 and at[1] - at[0] - m[0] >= 480)

    fits: dict[float, list] = {}
    for pick in itertools.product(*options):
        cost = round(sum(c for _, c in pick), 6)
        if feasible([h for h, _ in pick]) and cost <= timing.MOST_COST:
            fits.setdefault(cost, []).append([h for h, _ in pick])
    best = fits[min(fits)] if fits else []
    assert timing.hour_edits(s, m, k, 15, night, errand, locked, early) == (best[0] if len(best) == 1 else None)


def edits(*trips, **more):
    """day_edits of (start, minutes, motive) trips: w work, r return, v visit, s shops."""
    motives = [t[2] for t in trips]
    back = [x == "r" for x in motives]
    return timing.day_edits(
        [t[0] for t in trips], [t[1] for t in trips], [30 if x == "w" else 0 for x in motives],
        [b and i > 0 and motives[i - 1] == "w" for i, b in enumerate(back)], [x == "s" for x in motives], [*back[1:], False],
        more.get("locked", [False] * len(trips)), [x not in "wr" for x in motives],
    )


def test_days_that_need_no_edit_or_one():
    assert edits((480, 30, "v"), (500, 10, "r")) is None  # ten minutes of overlap are rounding
    assert edits((480, 30, "v"), (494, 10, "r")) is not None  # sixteen are not
    assert edits((1260, 30, "w"), (480, 30, "r")) is None  # a night shift
    assert edits((1260, 30, "w"), (120, 30, "r"), (960, 30, "w"), (1140, 30, "r")) == [-12, 12, 0, 0]  # not with work after it
    assert edits((444, 30, "v"), (457 + 30, 30, "v"), (1140, 30, "v"), (990, 30, "v"), (1082, 30, "v"), (1080, 30, "r")) == [0, 0, -10, 0, 0, 2]
    assert edits((540, 30, "s"), (1320, 20, "r")) == [0, -12]  # half a day at the shops
    assert edits((540, 30, "v"), (1320, 20, "r")) is None
    assert edits((180, 30, "v"), (840, 20, "r")) == [10, 0]  # three in the morning, then a long stay
    assert edits((480, 30, "w"), (120, 20, "r"), locked=[False, True]) is None


def test_slide_rules(spark):
    rows = [(1, 1, 480, 30, "v", False), (1, 2, 460, 20, "r", False), (2, 1, 480, 30, "w", False), (2, 2, 460, 20, "r", False), (3, 1, 480, 30, "w", False),
            (3, 2, 500, 20, "r", False), (4, 1, 480, 30, "v", False), (4, 2, 440, 20, "r", False), (5, 1, 480, 30, "v", False), (5, 2, 460, 20, "r", True)]
    df = spark.createDataFrame(rows, "person long, trip long, start long, minutes long, motive string, wraps boolean")
    got = {r.person: r.moved_start for r in chains.slide_to_arrival(df, ["person"], ["w"]).collect() if r.trip == 2}
    assert got == {1: 510, 2: 460, 3: 510, 4: 440, 5: 460}  # fifty minutes, not after work; ten after work; seventy; overnight


def test_start_times_are_read_again_after_the_slide(spark):
    day = [(480, 30, "w"), (1080, 20, "r"), (1200, 38, "v"), (1210, 20, "r")]
    rows = [(1, k, *t) for k, t in enumerate([day[0], (270, 30, "e"), *day[1:]], 1)]
    df = spark.createDataFrame(rows, "person long, trip long, start long, minutes long, motive string")
    got = {r.trip: (r.start, r.edited, r.slid) for r in timing.read_start_times(df, ["person"], ["w"], "r", ["w"]).collect()}
    assert got[2] == (990, True, False) and got[5] == (1238, False, True)


def test_clean_chains_end_to_end(spark):
    rules = cleaning.ChainRules("r", "o", ["w"], ["w"], ["s"], "d", "e", {7: "v"}, ["0"])
    rows = [(1, 1, 0, 5, "w", 480, 30), (1, 2, 5, 0, "r", 120, 30), (1, 3, 0, 0, "r", 1200, 5), (1, 4, 3, 7, "r", 1260, 10), (1, 5, 7, 0, "v", 1300, 10)]
    df = spark.createDataFrame(rows, "person long, trip long, origin long, dest long, motive string, start long, minutes long").withColumns(
        {"home": F.lit(0), "age": F.lit(30), "answer": F.lit(None).cast("string"), "from_type": F.lit("a"), "to_type": F.lit("b")})
    got = {r.trip: r for r in cleaning.clean_chains(df, ["person"], "person", rules).collect()}
    assert got[2].start == 840 and got[2].fixes == "hour" and got[3].issues == "no_trip_at_home"
    assert got[4].motive == "v" and got[4].fixes == "motive_of_place;origin_before" and got[4].origin == 0
    assert got[5].motive == "r" and got[5].fixes == "motive_home" and not any(got[k].issues for k in (1, 2, 4, 5))
    assert cleaning.clean_chains(df.limit(0), ["person"], "person", rules).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 4), st.booleans()), max_size=4))
def test_least_movement_equals_brute_force(chain):
    s, m, away = ([t[k] for t in chain] for k in range(3))
    got = timing.least_movement(s, m, away)
    assert all(got[i + 1] >= got[i] + m[i] for i in range(len(got) - 1))

    def cost(x):
        zero = sum(away[i] and x[i + 1] == x[i] + m[i] for i in range(len(x) - 1))
        return sum(abs(a - b) for a, b in zip(x, s)), sum(a != b for a, b in zip(x, s)), zero, sum(max(0, b - a) for a, b in zip(x, s))

    ways = itertools.product(range(0, 29), repeat=len(s)) if len(s) < 4 else []
    valid = [x for x in ways if all(x[i + 1] >= x[i] + m[i] for i in range(len(x) - 1))]
    if valid:
        assert cost(got) == min(map(cost, valid))


def test_chains_through_spark(spark):
    rows = [(1, 1, 480, 30, "w"), (1, 2, 120, 20, "r"), (2, 1, 600, 10, "r"), (2, 2, 700, 10, "r"), (3, 1, None, 5, "r"), (3, 2, 5, 5, "r")]
    df = spark.createDataFrame(rows, "person long, trip long, start long, minutes long, motive string")
    fixed = {(r.person, r.trip): r.repaired for r in timing.repair_start_hours(df, ["person"], ["w"]).collect()}
    assert fixed == {(1, 1): 480, (1, 2): 840, (2, 1): 600, (2, 2): 700, (3, 1): None, (3, 2): 5}
    moved = {(r.person, r.trip): r.moved_start for r in timing.isotonic_starts(df, ["person"]).collect()}
    assert moved[2, 1] == 600 and moved[3, 1] is None and moved[1, 2] >= moved[1, 1] + 30
    none = df.limit(0)
    assert timing.repair_start_hours(none, ["person"], ["w"]).count() == 0


def test_nearest_donors_over_many_batches(spark):
    donors = spark.range(0, 500, 1, 3).select(F.col("id").alias("d"), (F.col("id") % 3).alias("c"), (F.col("id") * 7 % 50).alias("x"))
    targets = spark.createDataFrame([(1, 0, 10), (2, None, None), (3, 2, 49)], "t long, c long, x long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = timing.nearest_donors(targets, donors, "t", "d", {"c": 5.0}, {"x": 1.0}, 7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for t, c, x in [(1, 0, 10), (2, None, None), (3, 2, 49)]:
        every = sorted((5.0 * (c != i % 3) + abs((x or 0) - i * 7 % 50), i) for i in range(500))
        assert sorted((r.distance, r.d) for r in got if r.t == t) == every[:7]


def test_nearest_donors_compare_few_pairs(spark):
    donors = spark.range(0, 6000).select(F.col("id").alias("d"), (F.col("id") % 5).alias("c"), (F.col("id") % 3).alias("e"), (F.col("id") * 7919 % 10007 / 10).alias("x"))
    targets = donors.where("d % 40 = 0").select(F.col("d").alias("t"), F.when(F.col("d") % 80 == 0, F.col("c")).alias("c"), "e", (F.col("x") + 0.03).alias("x"))
    same, numeric, seen = {"c": 3.0, "e": 1.0}, {"x": 0.05}, {}
    got = {}
    for r in timing.nearest_donors(targets, donors, "t", "d", same, numeric, 6, seen).collect():
        got.setdefault(r.t, []).append((r.distance, r.d))
    pool = donors.collect()
    for t in targets.collect():
        far = lambda o: round(3.0 * (t.c != o.c) + 1.0 * (t.e != o.e) + 0.05 * abs(t.x - o.x), 9)
        assert sorted((round(f, 6), d) for f, d in got[t.t]) == [(round(f, 6), d) for f, d in sorted((far(o), o.d) for o in pool)[:6]], t
    assert seen["compared"] < seen["all"] / 10


@pytest.mark.parametrize("n", [0, 3])
def test_nearest_donors_of_few(spark, n):
    donors = spark.range(n).select(F.col("id").alias("d"), F.lit(None).cast("string").alias("c"), F.col("id").alias("x"))
    got = timing.nearest_donors(spark.createDataFrame([(7, "a", 1)], "t long, c string, x long"), donors, "t", "d", {"c": 1.0}, {"x": 1.0}, 5)
    assert sorted((r.distance, r.d) for r in got.collect()) == [(1.0, 1), (2.0, 0), (2.0, 2)][:n]
