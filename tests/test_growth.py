"""What must not grow with the tables: rows moved, tables read again, rows of a task."""

import random

import numpy as np
from pyspark.sql import functions as F

from tripmill.jobs import ledger as ledger_jobs
from tripmill.operators import cleaning, companions, joins, model_chain, reports
from tripmill.operators.model_chain import linear_scorer
from tripmill.sources.staging import spread, stage


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_scores_do_not_move_the_rows(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("x"))
    scorers = [linear_scorer(["a", "b"], {"b": b}, {"b": {"x": 0.5}}) for b in (0.1, 0.7)]
    few = model_chain.score_written(df, ["x"], scorers, F.col("id"))
    many = model_chain.score_written(df, ["x"], scorers, F.col("id"), few=3)
    assert "strategy=broadcast" in plan(few) and "Join" not in plan(many)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_weights_are_compared_without_counting_distinct_ones(spark):
    child = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (3, None), (3, 4.0), (4, None)], "k long, cw double")
    parent = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 4, "b"), (4, 4, "c")], "k long, pw long, g string")
    got = reports.weight_consistency(child, parent, "k", "cw", "pw", "g")
    assert "distinct" not in plan(got)
    rows = {r.g: tuple(r)[1:] for r in got.collect()}
    assert rows == {"a": (2, 1, 1.75, 8.0, 6.0), "b": (1, 0, 1.0, 4.0, 8.0), "c": (1, 0, None, None, 4.0)}


def test_large_tables_are_dealt_to_more_tasks(spark):
    df = spark.range(1000)
    assert spread(df, "id", rows=10).rdd.getNumPartitions() == 100
    assert spread(df, "id") is df


def test_decisions_are_read_in_one_pass(spark):
    rows = stage(spark.range(1, 300).select((F.col("id") % 9).alias("person"), F.col("id").alias("trip"), F.lit("F").alias("motive"), (F.col("id") % 7).alias("area"), F.lit("BUS").alias("mode"), F.lit("a1").alias("answer")))
    assert plan(ledger_jobs._decisions(rows)).count("Relation") <= 2


def test_counts_read_the_cleaning_once(spark):
    df = spark.createDataFrame([("a;b", "c"), ("", "c;d")], "fixes string, issues string")
    got = cleaning.chain_counts(df)
    assert "Union" not in plan(got)
    assert {(r.kind, r.code): r.rows for r in got.collect()} == {("fixes", "a"): 1, ("fixes", "b"): 1, ("issues", "c"): 2, ("issues", "d"): 1}


def test_void_links_are_looked_up_from_the_link(spark):
    trips = [(1, p, t, o, d, m, s + 5 * (p - 1), 10) for p in (1, 2) for t, o, d, m, s in [(1, 0, 1, "a", 480), (2, 1, 2, "b", 600), (3, 2, 0, "r", 900)]]
    twice = trips + [(1, 2, 4, 1, 2, "b", 610, 10)]  # the second trip is the other member's fourth as well
    names = "hh long, person long, trip long, origin long, dest long, motive string, start long, minutes long"
    links = lambda rows: companions.companion_links(spark.createDataFrame(rows, names), ["hh"])
    assert plan(links(trips)).count("LeftAnti") == 2
    key = lambda rows: {(r.trip_a, r.trip_b) for r in links(rows).collect()}
    assert key(trips) == {(1, 1), (2, 2), (3, 3)} and key(twice) == {(1, 1), (3, 3)}


def test_only_near_pairs_are_put_in_order(spark):
    from tripmill.operators import timing

    donors = spark.range(3000).select(F.col("id").alias("d"), (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 997).alias("y"))
    targets = donors.where("d % 100 = 0").select(F.col("d").alias("t"), "x", "y")
    seen, got = {}, {}
    for r in timing.nearest_donors(targets, donors, "t", "d", {}, {"x": 1.0, "y": 1.0}, 5, seen).collect():
        got.setdefault(r.t, []).append((r.distance, r.d))
    pool = donors.collect()
    for t in targets.collect():
        assert sorted(got[t.t]) == sorted((float(abs(t.x - o.x) + abs(t.y - o.y)), o.d) for o in pool)[:5]
    assert seen["ordered"] < seen["compared"]


def test_a_group_hands_on_no_more_than_k_donors(spark):
    """Pairs are compared in arrays; only a target's k nearest of a group become rows."""
    from tripmill.operators import timing

    donors = spark.range(1500).select(F.col("id").alias("d"), (F.col("id") * 7919 % 6007 / 7).alias("x"))
    targets = donors.where("d % 60 = 0").select(F.col("d").alias("t"), (F.col("x") + 0.02).alias("x"))
    seen, got = {}, {}
    for r in timing.nearest_donors(targets, donors, "t", "d", {}, {"x": 1.0}, 5, seen).collect():
        got.setdefault(r.t, []).append((r.distance, r.d))
    ids, x = (np.array(c) for c in zip(*donors.collect()))
    for t in targets.collect():
        assert sorted(got[t.t]) == sorted(zip(timing.rounded(np.abs(t.x - x)).tolist(), ids.tolist()))[:5]
    assert seen["ordered"] <= 25 * 5 * 3


def test_targets_of_equal_features_are_one_cell(spark):
    from tripmill.operators import timing

    donors = spark.range(300).select(F.col("id").alias("d"), (F.col("id") % 20).alias("x"))
    targets = spark.range(1000).select(F.col("id").alias("t"), F.lit(3.5).alias("x"))
    asked, found = timing.nearest_by_cell(targets, donors, "t", "d", {}, {"x": 1.0}, 30)
    assert asked.count() == 1000 and asked.select("_q").distinct().count() == 1
    assert sorted((r.distance, r.d) for r in found.collect()) == sorted((abs(3.5 - i % 20), i) for i in range(300))[:30]


def test_rounded_equals_spark(spark):
    from tripmill.operators import timing

    rng = np.random.default_rng(3)
    x = [0.0, 0.5e-9, 1.5e-9, 2.5e-9, 0.1234567885, 1.0000000005, 2.0000000015, 8796.0930222085, 123456.1234567895, 1e8 + 0.1, 1e20, float("inf"), 1 / 60, 7 / 60]
    x += list(rng.random(500) * 10.0 ** rng.integers(-6, 9, 500)) + [round(v, 9) + 5e-10 for v in rng.random(200)]
    want = [r.r for r in spark.createDataFrame([(float(v), n) for n, v in enumerate(x)], "x double, n long").orderBy("n").select(F.round("x", 9).alias("r")).collect()]
    assert timing.rounded(np.array(x)).tolist() == want


def test_chains_without_lost_rows_are_written_once(spark, monkeypatch):
    from tripmill.operators import survey

    plain = [(p, k, 10 * p + k, 0, k, 1, 600 + p if k == 1 else 700 + p, 20, "shop" if k == 1 else "back", "mall") for p in range(40) for k in (1, 2)]
    lost = [(50, k, 1000 + k, 0, k, 1, None if k < 4 else 900, 20, None if k < 4 else "back", None) for k in range(1, 5)]
    names = "person long, trip long, event_id long, origin long, dest long, home long, start long, minutes long, motive string, kind string"
    df = spark.createDataFrame(plain + lost, names).withColumn("fixes", F.array().cast("array<string>"))
    rules = survey.SurveyRules("back", "other", same={"is_first": 1.0}, neighbours=5)
    written, real = [], survey.stage

    def staged(d):
        out = real(d)
        written.append((out.count(), "_open" in out.columns))
        return out

    monkeypatch.setattr(survey, "stage", staged)
    got = survey.impute_untimed(df, ["person"], "event_id", rules)
    assert got.count() == 84 and got.where("start IS NULL OR motive IS NULL").count() == 0 and got.columns == [*df.columns, "imputed"]
    # three rows in three passes: the whole table once, then the chain that is still open
    assert [n for n, rows in written if rows] == [84, 4, 4, 4]


def twins_by_pairs(persons, within):
    """(person -> its twins (gap, differs, twin)) of rows (hh, person, kind, starts), by all pairs."""
    out = {}
    for h, p, k, s in persons:
        gaps = [(max(abs(x - y) for x, y in zip(s, t)), k != l, q) for g, q, l, t in persons if g != h and len(s) == len(t)]
        if found := sorted(g for g in gaps if g[0] <= within):
            out[p] = found
    return out


def test_twins_make_no_pairs_of_persons(spark, monkeypatch):
    def paired(*_, **__):
        raise AssertionError("pairs of persons")

    rng = random.Random(4)
    persons = [(p // 3, p, rng.choice([0, 1, None]), [rng.randrange(480, 700), *sorted(rng.randrange(700, 900) for _ in range(p % 2 + 1))]) for p in range(150)]
    persons += [(200 + p % 3, 200 + p, p % 2, [600, 650]) for p in range(80)] + [(300, 300 + p, 0, [1300, 1400]) for p in range(5)] + [(400, 400, 0, [1100, 1161]), (401, 401, 0, [1115, 1170])]
    rows = [(1, h, p, t, x, "a") for h, p, _, s in persons for t, x in enumerate(s)]
    rows += [(1, 500, 500, 0, None, "a"), (1, 500, 500, 1, 600, "a"), (None, 501, 501, 0, 600, "a"), (None, 501, 501, 1, 650, "a"), (1, None, 502, 0, 600, "a"), (1, None, 502, 1, 650, "a")]
    chains = spark.createDataFrame(rows, "day int, hh long, person long, trip int, start long, motive string")
    kinds = spark.createDataFrame([(p, k) for _, p, k, _ in persons], "person long, kind int")
    want = twins_by_pairs(persons, 60)
    diary = (["day"], "hh", "person", "trip", "start", ["motive"])
    monkeypatch.setattr(joins, "repeated_diary_pairs", paired)
    monkeypatch.setattr(joins, "TASK_ROWS", 500)  # more tasks than one
    got = companions.closest_twin(joins.diaries_of(chains, *diary), kinds, ["day"], "person", ["kind"], 60, [(10, "minutes")], "hour").collect()
    assert {r.person: (r.max_offset, not r.same, r.twin) for r in got} == {p: found[0] for p, found in want.items()}
    assert all(r.offset_class == ("minutes" if r.max_offset <= 10 else "hour") for r in got) and len({r.max_offset for r in got}) > 3
    counts = joins.diary_twins(chains, *diary, 60)
    assert {r.person: r.twins for r in counts.collect()} == {p: len(found) for p, found in want.items()}
    # a hundred copies of a class: one comparison, not ten thousand
    one = joins.diaries_of(chains.where("person BETWEEN 200 AND 279"), *diary)
    classes = one.select("day", "sig", "s").distinct()
    assert joins.meet_in_cells(classes, classes.withColumnRenamed("s", "t"), ["day", "sig"], 60).count() == 1


def test_queries_on_twins_make_no_pairs_of_persons(spark, monkeypatch):
    import __spark_entry__

    def paired(*_, **__):
        raise AssertionError("pairs of persons")

    monkeypatch.setattr(joins, "repeated_diary_pairs", paired)
    for name in ("closest_twin", "flag_repeated_diaries"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").count()
