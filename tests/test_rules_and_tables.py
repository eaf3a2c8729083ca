"""Errors that name what is wrong, and small results written out: units, constraints, ledger, model tables, medians."""

import statistics

import pytest
from pyspark.sql import functions as F

from tripmill.operators import clean, harmonize, issues, joins, ledger, model_tables, stats, targets, units
from tripmill.operators.model_tables import Codes, Field
from tripmill.operators.targets import Constraint

# -- medians and twins ----------------------------------------------------------------------


@pytest.mark.parametrize("cells", [1, 2, 1024])
def test_medians_equal_sorted_ones(spark, cells):
    rows = [(g, float((k * k * 7) % (11 + g))) for g in range(4) for k in range(3 + g * 5)] + [(9, None), (None, 2.0), (None, 4.0)]
    got = {r.g: r.median for r in stats.medians(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", cells).collect()}
    want = {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in (0, 1, 2, 3, None)}
    assert got == want


def test_twins_are_counted_without_pairs(spark):
    rows = []
    for p in range(60):  # one common diary, starts on three minutes, two persons a household
        rows += [(1, p // 2, p, t, 480 + 8 * (p % 3) + 60 * t, "a") for t in (1, 2)]
    rows += [(1, 99, 99, t, 1000 + t, "a") for t in (1, 2)] + [(2, 98, 98, 1, 480, "a")]
    df = spark.createDataFrame(rows, "day int, hh long, person long, trip long, start long, motive string")
    got = {r.person: r.twins for r in joins.diary_twins(df, ["day"], "hh", "person", "trip", "start", ["motive"], 10).collect()}
    for p in range(60):
        assert got[p] == sum(q // 2 != p // 2 and abs(8 * (p % 3) - 8 * (q % 3)) <= 10 for q in range(60))
    assert set(got) == set(range(60))


# -- recoding ---------------------------------------------------------------------------------


def test_recoding_names_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 12, "a;b"), (2, None, None), (3, 35, "")], "k long, code long, flags string")
    got = harmonize.map_variable(df, "code", "level", {1: "one"}, 10, "rest", [1, 2, 3], "missing").orderBy("k").collect()
    assert [r.level for r in got] == ["one", "missing", "rest"]
    with pytest.raises(ValueError, match="outside the domain .'3'"):
        harmonize.map_variable(df, "code", "level", {1: "one"}, 10)
    assert harmonize.assert_known_levels(df, {"flags": ["a;b", ""]}) is df
    with pytest.raises(ValueError, match="undeclared levels.*a;b"):
        harmonize.assert_known_levels(df, {"flags": [""]})
    flags = clean.flags_to_columns(df, "flags", ["a", "c"]).orderBy("k").collect()
    assert [(r.a, r.c) for r in flags] == [(True, False), (False, False), (False, False)]
    parent = spark.createDataFrame([(1, 12), (2, None), (3, 30)], "k long, code long")
    with pytest.raises(ValueError, match="code.*1"):
        clean.drop_inherited(df, parent, "k", ["code"])
    with pytest.raises(ValueError, match="no_parent.*1"):
        clean.drop_inherited(df.select("k"), parent.where("k < 3"), "k", [])
    assert clean.drop_inherited(df, df.select("k", "code"), "k", ["code"]).columns == ["k", "flags"]


# -- zones and targets ------------------------------------------------------------------------


def test_rural_fill_takes_the_nearest_until_the_sample_fits(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 1.0}, {"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 0.0}]
    polygons = spark.createDataFrame([(5, square)], "zone long, ring array<struct<x:double,y:double>>")
    rows = [("a", "r1", 10, 4, 5, 0.5, 0.5), ("b", "r1", 10, 3, None, 3.0, 0.5), ("c", "r1", 20, 2, None, 2.0, 0.5), ("d", "r1", 30, 9, None, 2.0, 0.5), ("e", "r1", 1, 50, None, 9.0, 0.5),
            ("f", "r2", 5, 7, None, 4.0, 4.0), ("g", "r2", 9, 7, None, 3.0, 3.0), ("h", None, 1, 1, 5, 0.2, 0.2), ("i", "r9", 1, 1, None, 7.0, 7.0)]
    places = spark.createDataFrame(rows, "unit string, area string, population long, dwellings long, polygon_zone long, x double, y double")
    codes = spark.createDataFrame([("r1", "dwellings", 5, 14), ("r2", "trips", 5, 3), ("r3", "trips", 5, 1)], "code string, source string, zone long, n long")
    got = {r.unit: (r.zone, r.rule) for r in units.rural_units(places, codes, polygons).collect()}
    # in r1: a lies inside (4 dwellings), then d (nearest, most people: 13), then c (15); r2 has none inside: the nearest
    assert got == {"a": (5, "survey"), "d": (5, "survey"), "c": (5, "survey"), "b": (None, "outside"), "e": (None, "outside"), "g": (5, "trip ends"), "f": (None, "outside"),
                   "h": (5, "polygon"), "i": (None, "outside"), "r3": (5, "trip ends")}


def test_suppressed_constraints_stay_null(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 4), (2, 5, None), (2, None, 1)], "zone long, a long, b long")
    spec = [Constraint("a", "zone", "a", ["a"]), Constraint("both", "zone", "a + b", ["a", "b"]), Constraint("fixed", "zone", constant={1: 10, 2: 20}, share="s")]
    shares = {"zone": spark.createDataFrame([(1, 0.5), (2, 0.25)], "zone long, s double")}
    got = {(r.id, r.constraint): r.target for r in targets.constraint_set(df, spec, shares).collect()}
    assert got == {("1", "a"): None, ("1", "both"): None, ("1", "fixed"): 5.0, ("2", "a"): 5.0, ("2", "both"): 6.0, ("2", "fixed"): 5.0}
    with pytest.raises(ValueError, match="not the ids"):
        targets.constraint_set(df, [Constraint("c", "zone", constant={1: 1})])
    with pytest.raises(ValueError, match="no share table"):
        targets.constraint_set(df, spec)
    with pytest.raises(Exception, match="no share for zone 2"):
        targets.constraint_set(df, spec, {"zone": shares["zone"].where("zone = 1")}).collect()


# -- the ledger -------------------------------------------------------------------------------


def test_a_ledger_with_problems_applies_nothing(spark):
    columns = "person long, trip long, motive string, zone string, answer string, fixes string"
    shipped = spark.createDataFrame([(1, 1, "a", "z", "home", ""), (1, 2, "b", "z", "home", ""), (1, 3, "c", "z", "home", "")], columns)
    rules = shipped.where("trip < 3").withColumns({"motive": F.when(F.col("trip") == 1, "r").otherwise(F.col("motive")), "fixes": F.when(F.col("trip") == 1, "motive:rule").otherwise("")})
    legs = shipped.select("person", "trip", F.lit(1).alias("leg"))
    book = ledger.Ledger({"motive": ["a", "b", "c", "r"], "zone": None, "answer": None})

    def run(rows, **more):
        d = spark.createDataFrame([(1, *r) for r in rows], "person long, trip long, field string, before string, after string")
        resolved = ledger.resolve(d, rules, rules, shipped, book)
        outcome = {(r.trip, r.field): r.outcome for r in resolved.collect()}
        persons = spark.createDataFrame([(1, 2)], "person long, trips long")
        return outcome, lambda: ledger.apply_ledger(rules, legs.where("trip < 3"), persons, resolved, rules, shipped, legs, book, **more)

    outcome, apply = run([(1, "motive", "r", "A"), (3, "status", "", "restored"), (3, "motive", "c", "b"), (2, "status", "", "dropped"), (2, "zone", "z", "y"), (0, "answer", "home", "work")])
    assert outcome == {(1, "motive"): "apply", (3, "status"): "apply", (3, "motive"): "apply", (2, "status"): "apply", (2, "zone"): "moot", (0, "answer"): "apply"}
    trips, kept, people = apply()
    assert {r.trip: (r.motive, r.answer, r.fixes) for r in trips.collect()} == {1: ("a", "work", "answer:revision"), 3: ("b", "work", "motive:revision;answer:revision;row:revision")}
    assert {r.trip for r in kept.collect()} == {1, 3} and people.first().trips == 2
    outcome, apply = run([(1, "motive", "a", "b"), (2, "motive", "b", "q")])
    assert outcome == {(1, "motive"): "stale", (2, "motive"): "problem"}
    with pytest.raises(ValueError, match="cannot be applied"):
        apply()


# -- model tables -----------------------------------------------------------------------------


def test_model_tables_need_their_draws_and_weights(spark):
    hh = spark.createDataFrame([(1, 7, "two", "one"), (2, 8, "many", None)], "hh long, zone long, told string, cars string")
    members = spark.createDataFrame([(1,), (1,), (1,)], "hh long")
    draws = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (1, 2, "y")], "hh long, draw int, level string")
    weights = spark.createDataFrame([(1, 2.0), (2, 3.0)], "hh long, w double")
    run = lambda draw, w: model_tables.model_households(hh, members, draws, draw, "hh", "zone", ("told", Codes({"two": 2}, 5)), {"cars": Codes({"one": 1}, 0)}, ("level", Codes({"x": 1, "y": 2}, 9)), "w", w)
    assert [tuple(r) for r in run(1, weights).orderBy("hh").collect()] == [(1, 7, 3, 1, 1, 2.0), (2, 8, 5, 0, 2, 3.0)]
    with pytest.raises(Exception, match="no drawn level for 2"):
        run(2, weights).collect()
    with pytest.raises(Exception, match="no expansion weight for household 2"):
        run(1, weights.where("hh = 1")).collect()


def test_contracts_count_problems(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.5), (2, None, -1.0), (3, "?", 99.0)], "id long, c string, n double")
    found = {r.problem: r.rows for r in model_tables.check_contract(df, {"id": Field("int"), "c": Field(domain=["a", "b"], sentinels=["?"]), "n": Field("int", range=(0, 50), sentinels=[99.0]), "z": Field(zone=True)}, ["id"]).collect()}
    assert found == {"missing:z": 1, "null:c": 1, "not_whole:n": 1, "below:n": 1, "duplicate_key": 1}
    assert model_tables.check_contract(df.limit(0), {"id": Field("int")}, ["id"]).where("NOT problem LIKE 'extra%'").count() == 0


def test_issue_codes_of_a_literal_day(spark):
    rows = [(1, 1, 1, 1, 0, 5, 0, "work", "office", "home", 480, 30, 1, False), (1, 1, 1, 2, 5, 0, 0, "back", "home", "home", 541, 30, 1, False), (1, 1, 1, 3, 0, 6, 0, "shop", "home", "home", 1381, 5, 2, False)]
    df = spark.createDataFrame(rows, "hh long, day int, person long, trip long, origin long, dest long, home long, motive string, kind string, answer string, start long, minutes long, mode long, edited boolean")
    got = {r.trip: r.issues for r in issues.issue_codes(df, ["hh", "day"], "person", issues.Labels("back", ["work"], ["work"])).collect()}
    assert got == {1: "", 2: "gap_61", 3: "last_away;activity_at_home;start_2301"}
    assert issues.chain_screens(df.limit(0), ["hh", "day"], "person", issues.Labels("back")).count() == 0
