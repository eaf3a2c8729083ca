"""Chains of scored models against sums written out, and draws against enumeration."""

import math

import pytest
from pyspark.sql import functions as F

from tripmill.operators import model_chain, models
from tripmill.operators.model_chain import Auxiliary, Derive, Step, Support, linear_scorer


def soft(*z):
    e = [math.exp(v) for v in z]
    return [v / sum(e) for v in e]


A = linear_scorer(["a", "b", "c"], {"b": 0.4}, {"b": {"x": 0.5}, "c": {"x": -0.3}})
B = linear_scorer(["n", "y"], {}, {"y": {"u": {"hi": 1.0}, "x": 0.2}})
C = linear_scorer(["p", "q"], {"q": -0.5}, {"q": {"ua": {"a": 0.8}, "ub": {"y": 0.6}}})
STEPS = [
    Step("one", ["a", "b", "c"], ["x"], [A]),
    Step("two", ["n", "y"], ["u", "x"], [B], {"one": ("u", {"a": "hi", "b": "lo", "c": "hi"})}, "seen"),
    Step("three", ["p", "q"], ["ua", "ub"], [C], {"one": ("ua", None), "two": ("ub", None)}),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 0.0, None), (2, 1.0, None), (3, 2.0, "n"), (4, None, None), (5, 1.0, "y")], "id long, x double, seen string")


def by_hand(x, seen):
    x = x or 0.0
    pa = dict(zip("abc", soft(0, 0.4 + 0.5 * x, -0.3 * x)))
    two, three = 0.0, 0.0
    for a, w in pa.items():
        y = soft(0, (a in "ac") * 1.0 + 0.2 * x)[1] if seen is None else float(seen == "y")
        two += w * y
        for b, v in (("n", 1 - y), ("y", y)):
            three += w * v * soft(0, -0.5 + 0.8 * (a == "a") + 0.6 * (b == "y"))[1]
    return list(pa.values()), two, three


def test_enumeration_is_the_sum_over_scenarios(spark, rows):
    done = model_chain.run_chain(rows, "id", STEPS)
    got = {s: {r.id: r.p for r in m.collect()} for s, m in done.marginals.items()}
    for r in rows.collect():
        one, two, three = by_hand(r.x, r.seen)
        assert got["one"][r.id] == pytest.approx(one, abs=1e-12)
        assert got["two"][r.id][1] == pytest.approx(two, abs=1e-12) and got["three"][r.id][1] == pytest.approx(three, abs=1e-12)
    sums = done.completions.groupBy("id").agg(F.sum("weight").alias("w"), F.count_distinct("completion").alias("d"), F.count("*").alias("n")).collect()
    assert all(r.w == pytest.approx(1) and r.d == r.n for r in sums)
    assert done.conditionals["two"].count() == 10  # every row at either level
    assert model_chain.run_chain(rows.limit(0), "id", STEPS).completions.count() == 0


def test_draws_converge_and_repeat(spark, rows):
    exact = {r.id: r.p for r in model_chain.run_chain(rows, "id", STEPS).marginals["three"].collect()}
    done = model_chain.run_chain(rows, "id", STEPS, "draws", 400, 3)
    drawn = {r.id: r.p for r in done.marginals["three"].collect()}
    assert max(abs(drawn[k][1] - exact[k][1]) for k in exact) < 0.06
    again = model_chain.run_chain(rows.repartition(3), "id", STEPS, "draws", 400, 3)
    assert done.completions.exceptAll(again.completions).count() == 0
    shares = model_chain.value_shares(done, "id", "two").where("id = 5").collect()
    assert [(r.level, round(r.prob, 9)) for r in shares] == [("y", 1.0)]


def test_each_draw_has_its_own_model(spark, rows):
    other = linear_scorer(["a", "b", "c"], {"a": 2.0}, {})
    done = model_chain.run_chain(rows, "id", [Step("one", ["a", "b", "c"], ["x"], [A, other])], "draws", 6, 1)
    got = {r.id: r.p for r in done.marginals["one"].collect()}
    want = [(p + q) / 2 for p, q in zip(soft(0, 0.4 + 0.5, -0.3), soft(2, 0, 0))]
    assert got[2] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError, match="must be draws"):
        model_chain.run_chain(rows, "id", [Step("one", ["a", "b", "c"], ["x"], [A, other])])


def test_wrong_chains_are_errors(rows):
    with pytest.raises(ValueError, match="no earlier step"):
        model_chain.run_chain(rows, "id", STEPS[1:])
    with pytest.raises(ValueError, match="cover"):
        model_chain.run_chain(rows, "id", [STEPS[0], Step("two", ["n", "y"], ["u"], [B], {"one": ("u", {"a": "hi"})})])


def test_derived_values_on_fitted_models(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("f"), ((F.col("id") * 7 % 10) < 3 + 4 * (F.col("id") % 2)).cast("int").alias("y"), F.lit(1.0).alias("w"))
    model = models.fit(models.encode(df, {"f": ["s", "t"]}), F.col("y"), "w")
    step = Step("guess", ["0", "1"], ["f"], [model_chain.fitted_scorer(model, {"f": ["s", "t"]})])
    done = model_chain.run_chain(df, "id", [step, Derive("points", F.when(F.col("guess") == "1", 10).otherwise(0))])
    got = {r.id: r.p[1] for r in done.marginals["guess"].where("id < 2").collect()}
    share = {r.f: r.m for r in df.groupBy("f").agg(F.avg("y").alias("m")).collect()}
    assert got[0] == pytest.approx(share["s"], abs=1e-3) and got[1] == pytest.approx(share["t"], abs=1e-3)
    assert {r.level for r in model_chain.value_shares(done, "id", "points").collect()} == {0, 10}


def test_persons_feed_households_draw_by_draw(spark, rows):
    homes = spark.createDataFrame([(10,), (11,)], "hh long")
    persons = rows.withColumn("hh", F.lit(10).cast("long"))
    own, house = model_chain.pipeline_two_levels(
        persons, "id", STEPS[:1], homes, "hh", [Step("z", ["p", "q"], ["n"], [linear_scorer(["p", "q"], {}, {"q": {"n": 0.5}})])],
        lambda d: d["one"] == "a", "n", 3, 20, 5,
    )
    counts = {r.completion: min(r.n, 3) for r in own.completions.groupBy("completion").agg(F.count_if(F.col("one") == "a").alias("n")).collect()}
    got = {r.completion: r.n for r in house.completions.where("hh = 10").collect()}
    assert got == counts and {r.n for r in house.completions.where("hh = 11").collect()} == {0}
    mean = house.marginals["z"].where("hh = 10").first().p[1]
    assert mean == pytest.approx(sum(soft(0, 0.5 * n)[1] for n in counts.values()) / 20, abs=1e-12)


def test_marginalisation_with_a_level_model(spark):
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("missing", 0.1)], "level string, share double")
    df = spark.createDataFrame([(1, "a", 1.0), (2, "new", 1.0), (3, None, 2.0)], "id long, f string, x double")
    main = linear_scorer(["n", "y"], {}, {"y": {"f": {"a": 1.0, "b": -1.0}, "x": 0.1}})
    aux = Auxiliary(["a", "b", "c"], ["x"], linear_scorer(["a", "b", "c"], {}, {"a": {"x": 0.4}}))
    p = lambda f, x: soft(0, {"a": 1.0, "b": -1.0}.get(f, 0) + 0.1 * x)[1]
    got = {r.id: (r.p[1], r.features) for r in model_chain.marginalize(df, "id", ["f", "x"], {"f": Support(shares, ["a", "b"], aux)}, main, 2).collect()}
    assert got[1] == (pytest.approx(p("a", 1)), "")
    for k, x in ((2, 1.0), (3, 2.0)):
        a, b, _ = soft(0.4 * x, 0, 0)
        assert got[k] == (pytest.approx((a * p("a", x) + b * p("b", x)) / (a + b)), "f")
    plain = {r.id: r.p[1] for r in model_chain.marginalize(df, "id", ["f", "x"], {"f": Support(shares)}, main, 2).collect()}
    assert plain[2] == pytest.approx(0.5 * p("a", 1) + 0.3 * p("b", 1) + 0.2 * p("c", 1))
    with pytest.raises(Exception, match="combinations"):
        model_chain.marginalize(df, "id", ["f", "x"], {"f": Support(shares)}, main, 2, most=2).collect()
