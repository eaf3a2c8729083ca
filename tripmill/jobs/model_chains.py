"""Registered queries on chains of scored models and their marginalisation, each with its SQL.

The models have given coefficients, so that SQL can write them out; fitted models take
the same place through `fitted_scorer` (see the tests)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.operators import model_chain, models
from tripmill.operators.model_chain import Auxiliary, Step, Support, linear_scorer
from tripmill.sources.tables import read

from .queries import query
from .records import UNIFORM

JOB = linear_scorer(
    ["none", "part", "full"], {"part": -0.3, "full": 0.2},
    {"part": {"pri": {"1-URGENT": 0.8}, "k": 0.1}, "full": {"pri": {"5-LOW": -0.5}, "k": -0.05}},
)
NET = linear_scorer(["no", "yes"], {"yes": 0.1}, {"yes": {"work": {"busy": 0.9}, "k": -0.2}})
CAR = linear_scorer(
    ["zero", "one", "two"], {"one": 0.3, "two": -0.5},
    {"one": {"job_in": {"full": 0.7}, "status": {"F": -0.4}}, "two": {"net_in": {"yes": 1.1}}},
)
STEPS = [
    Step("job", ["none", "part", "full"], ["pri", "k"], [JOB]),
    Step("net", ["no", "yes"], ["work", "k"], [NET], {"job": ("work", {"none": "idle", "part": "busy", "full": "busy"})}, "seen"),
    Step("car", ["zero", "one", "two"], ["job_in", "net_in", "status"], [CAR], {"job": ("job_in", None), "net": ("net_in", None)}),
]

ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS pri, o_custkey % 7 AS k, o_orderstatus AS status,
    CASE WHEN o_orderkey % 9 = 0 THEN 'yes' END AS seen FROM orders)"""
JOBS = """pj AS (SELECT *, ej / sum(ej) OVER (PARTITION BY o_orderkey) AS pj FROM (SELECT o.*, job, CASE job WHEN 'none' THEN 1.0
    WHEN 'part' THEN exp(-0.3 + CASE WHEN pri = '1-URGENT' THEN 0.8 ELSE 0 END + 0.1 * k)
    ELSE exp(0.2 - CASE WHEN pri = '5-LOW' THEN 0.5 ELSE 0 END - 0.05 * k) END AS ej FROM o, (VALUES ('none'), ('part'), ('full')) v(job)))"""
SCENARIOS = f"""{ORDERS}, {JOBS},
pn AS (SELECT *, CASE WHEN seen IS NOT NULL THEN (net = seen)::INT ELSE en / sum(en) OVER (PARTITION BY o_orderkey, job) END AS pn FROM (
    SELECT pj.*, net, CASE net WHEN 'no' THEN 1.0 ELSE exp(0.1 + CASE WHEN job <> 'none' THEN 0.9 ELSE 0 END - 0.2 * k) END AS en
    FROM pj, (VALUES ('no'), ('yes')) v(net))),
pc AS (SELECT *, ec / sum(ec) OVER (PARTITION BY o_orderkey, job, net) AS pc FROM (
    SELECT pn.*, car, CASE car WHEN 'zero' THEN 1.0
      WHEN 'one' THEN exp(0.3 + CASE WHEN job = 'full' THEN 0.7 ELSE 0 END - CASE WHEN status = 'F' THEN 0.4 ELSE 0 END)
      ELSE exp(-0.5 + CASE WHEN net = 'yes' THEN 1.1 ELSE 0 END) END AS ec FROM pn, (VALUES ('zero'), ('one'), ('two')) v(car)))"""


def _orders(spark, folder) -> DataFrame:
    return read(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("pri"), (F.col("o_custkey") % 7).alias("k"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 9 == 0, "yes").alias("seen"),
    )


def _levels(found: dict[str, DataFrame], steps) -> DataFrame:
    """(o_orderkey, step, level, prob) of arrays of probabilities."""
    parts = []
    for s in steps:
        arms = F.explode(F.arrays_zip(F.array(*map(F.lit, s.classes)).alias("level"), F.col("p").alias("prob")))
        parts.append(found[s.name].select("o_orderkey", F.lit(s.name).alias("step"), arms.alias("a")).select("o_orderkey", "step", "a.level", F.round("a.prob", 6).alias("prob")))
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {SCENARIOS}
SELECT o_orderkey, 'job' AS step, job AS level, round(pj, 6) AS prob FROM pj
UNION ALL SELECT o_orderkey, 'net', net, round(sum(pj * pn), 6) FROM pn GROUP BY ALL
UNION ALL SELECT o_orderkey, 'car', car, round(sum(pj * pn * pc), 6) FROM pc GROUP BY ALL"""
)
def chain_model_enumerate(spark, folder):
    return _levels(model_chain.run_chain(_orders(spark, folder), "o_orderkey", STEPS).marginals, STEPS)


@query(
    f"""WITH {SCENARIOS}
SELECT o_orderkey, job, net, car, round(pj * pn * pc, 6) AS weight FROM pc WHERE pj * pn * pc > 0"""
)
def chain_model_completions(spark, folder):
    done = model_chain.run_chain(_orders(spark, folder), "o_orderkey", STEPS).completions
    return done.select("o_orderkey", "job", "net", "car", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {ORDERS}
SELECT o_orderkey, w AS level, round(CASE WHEN seen IS NOT NULL THEN 1.0 ELSE 1 - 1 / (1 + exp(0.1 + CASE w WHEN 'busy' THEN 0.9 ELSE 0 END - 0.2 * k)) END, 6) AS yes
FROM o, (VALUES ('busy'), ('idle')) v(w)"""
)
def chain_model_conditionals(spark, folder):
    found = model_chain.run_chain(_orders(spark, folder), "o_orderkey", STEPS[:2]).conditionals["net"]
    return found.select("o_orderkey", "level", F.round(F.get("p", F.lit(1)), 6).alias("yes"))


DRAWN = f"""{ORDERS}, u AS (SELECT o.*, draw, {UNIFORM.format("o_orderkey, draw, 0, 31")} AS u0, {UNIFORM.format("o_orderkey, draw, 1, 31")} AS u1,
    {UNIFORM.format("o_orderkey, draw, 2, 31")} AS u2, 1.0 AS e0, exp(-0.3 + CASE WHEN pri = '1-URGENT' THEN 0.8 ELSE 0 END + 0.1 * k) AS e1,
    exp(0.2 - CASE WHEN pri = '5-LOW' THEN 0.5 ELSE 0 END - 0.05 * k) AS e2 FROM o, range(1, 5) v(draw)),
j AS (SELECT *, CASE WHEN u0 * (e0 + e1 + e2) < e0 THEN 'none' WHEN u0 * (e0 + e1 + e2) < e0 + e1 THEN 'part' ELSE 'full' END AS job FROM u),
n AS (SELECT *, CASE WHEN seen IS NOT NULL THEN 1.0 ELSE 1 - 1 / (1 + exp(0.1 + CASE WHEN job <> 'none' THEN 0.9 ELSE 0 END - 0.2 * k)) END AS yes FROM j),
m AS (SELECT *, CASE WHEN u1 < 1 - yes THEN 'no' ELSE 'yes' END AS net FROM n),
f AS (SELECT *, exp(0.3 + CASE WHEN job = 'full' THEN 0.7 ELSE 0 END - CASE WHEN status = 'F' THEN 0.4 ELSE 0 END) AS f1,
    exp(-0.5 + CASE WHEN net = 'yes' THEN 1.1 ELSE 0 END) AS f2 FROM m),
c AS (SELECT *, CASE WHEN u2 * (1 + f1 + f2) < 1 THEN 'zero' WHEN u2 * (1 + f1 + f2) < 1 + f1 THEN 'one' ELSE 'two' END AS car FROM f)"""


@query(f"WITH {DRAWN} SELECT o_orderkey, draw AS completion, 0.25 AS weight, job, net, car FROM c")
def chain_model_draws(spark, folder):
    return model_chain.run_chain(_orders(spark, folder), "o_orderkey", STEPS, "draws", 4, 31).completions


@query(
    f"""WITH {DRAWN}
SELECT o_orderkey, round(avg(yes), 6) AS net_yes, round(avg(f1 / (1 + f1 + f2)), 6) AS car_one FROM c GROUP BY 1"""
)
def chain_model_mean_conditional(spark, folder):
    found = model_chain.run_chain(_orders(spark, folder), "o_orderkey", STEPS, "draws", 4, 31).marginals
    net = found["net"].select("o_orderkey", F.round(F.get("p", F.lit(1)), 6).alias("net_yes"))
    return net.join(found["car"].select("o_orderkey", F.round(F.get("p", F.lit(1)), 6).alias("car_one")), "o_orderkey")


@query(
    f"""WITH {ORDERS}, u AS (SELECT o.*, draw, {UNIFORM.format("o_orderkey, draw, 0, 41")} AS u0, exp(-0.3 + CASE WHEN pri = '1-URGENT' THEN 0.8 ELSE 0 END + 0.1 * k) AS e1,
    exp(0.2 - CASE WHEN pri = '5-LOW' THEN 0.5 ELSE 0 END - 0.05 * k) AS e2 FROM o, range(1, 4) v(draw)),
w AS (SELECT o_custkey AS c_custkey, draw, count(*) FILTER (u0 * (1 + e1 + e2) >= 1) AS n FROM u GROUP BY 1, 2),
h AS (SELECT c_custkey, c_mktsegment AS segment, draw, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS workers, {UNIFORM.format("c_custkey, draw, 0, 42")} AS u
    FROM customer CROSS JOIN range(1, 4) v(draw) LEFT JOIN w USING (c_custkey, draw)),
z AS (SELECT *, 1 / (1 + exp(-0.6 + 0.5 * workers + CASE WHEN segment = 'BUILDING' THEN 0.4 ELSE 0 END)) AS none FROM h)
SELECT c_custkey, draw AS completion, workers, CASE WHEN u < none THEN 'none' ELSE 'some' END AS cars, round(avg(1 - none) OVER (PARTITION BY c_custkey), 6) AS some FROM z"""
)
def pipeline_two_levels_scored(spark, folder):
    homes = read(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    persons = _orders(spark, folder).withColumnRenamed("o_custkey", "c_custkey")
    cars = Step("cars", ["none", "some"], ["workers", "segment"], [linear_scorer(["none", "some"], {"some": -0.6}, {"some": {"workers": 0.5, "segment": {"BUILDING": 0.4}}})])
    _, done = model_chain.pipeline_two_levels(
        persons, "o_orderkey", STEPS[:1], homes, "c_custkey", [cars], lambda d: d["job"] != "none", "workers", 3, 3, 41
    )
    some = done.marginals["cars"].select("c_custkey", F.round(F.get("p", F.lit(1)), 6).alias("some"))
    return done.completions.select("c_custkey", "completion", "workers", "cars").join(some, "c_custkey")


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'new' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS pri, o_custkey % 7 AS k FROM orders),
train AS (SELECT o_orderstatus, o_orderpriority, 1 + o_custkey % 7 AS w FROM orders WHERE o_custkey % 3 <> 0),
sl AS (SELECT DISTINCT o_orderstatus AS s FROM train),
pl AS (SELECT o_orderpriority AS p, sum(w)::DOUBLE AS w FROM train WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') GROUP BY 1),
pw AS (SELECT p, w / sum(w) OVER () AS q FROM pl),
sx AS (SELECT o_orderkey, s, CASE s WHEN 'F' THEN 1.0 WHEN 'O' THEN exp(0.2 - 0.1 * k) ELSE exp(-1 + 0.3 * k) END AS e FROM o, sl WHERE status NOT IN (SELECT s FROM sl)),
su AS (SELECT o_orderkey, s, e / sum(e) OVER (PARTITION BY o_orderkey) AS q FROM sx
  UNION ALL SELECT o_orderkey, status, 1 FROM o WHERE status IN (SELECT s FROM sl)),
pu AS (SELECT o_orderkey, p, q FROM o, pw WHERE pri IS NULL UNION ALL SELECT o_orderkey, pri, 1 FROM o WHERE pri IS NOT NULL)
SELECT o_orderkey, round(sum(su.q * pu.q * (1 - 1 / (1 + exp(-0.2 + CASE s WHEN 'F' THEN 0.7 WHEN 'P' THEN -0.6 ELSE 0 END + CASE p WHEN '1-URGENT' THEN 0.9 WHEN '5-LOW' THEN -0.3 ELSE 0 END + 0.05 * k)))), 6) AS yes,
  concat_ws('+', CASE WHEN any_value(status) = 'new' THEN 'status' END, CASE WHEN any_value(pri) IS NULL THEN 'pri' END) AS features
FROM o JOIN su USING (o_orderkey) JOIN pu USING (o_orderkey) GROUP BY o_orderkey"""
)
def marginalize_auxiliary(spark, folder):
    o = _orders(spark, folder)
    train = o.where("o_custkey % 3 <> 0").withColumn("w", (1 + F.col("k")).cast("double"))
    shares = lambda c: models.level_shares(train, c, "w").withColumnRenamed(c, "level")
    aux = Auxiliary(["F", "O", "P"], ["k"], linear_scorer(["F", "O", "P"], {"O": 0.2, "P": -1.0}, {"O": {"k": -0.1}, "P": {"k": 0.3}}))
    supports = {"status": Support(shares("status"), auxiliary=aux), "pri": Support(shares("pri"), ["1-URGENT", "3-MEDIUM", "5-LOW"])}
    main = linear_scorer(["no", "yes"], {"yes": -0.2}, {"yes": {"status": {"F": 0.7, "P": -0.6}, "pri": {"1-URGENT": 0.9, "5-LOW": -0.3}, "k": 0.05}})
    rows = o.select(
        "o_orderkey", "k", F.when(F.col("o_orderkey") % 11 == 0, "new").otherwise(F.col("status")).alias("status"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("pri")).alias("pri"),
    )
    done = model_chain.marginalize(rows, "o_orderkey", ["status", "pri", "k"], supports, main, 2)
    return done.select("o_orderkey", F.round(F.get("p", F.lit(1)), 6).alias("yes"), "features")
