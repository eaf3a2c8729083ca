"""Chains of models: each step is scored on features that earlier steps fill.

A row's completions are its scenarios (enumerate) or draws, with weights that sum to one.
A step fills features from earlier values, scores the distinct feature combinations once
by its model, joins the probabilities back and carries its value on. The marginal of a
step is the weighted mean of its conditionals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.sources.staging import stage

from .imputation import uniform
from .models import encode

#: Adds `p`, an array of class probabilities, to rows of features.
Scorer = Callable[[DataFrame], DataFrame]
#: Copies of a scored combination, so that a combination that most rows share is dealt over tasks.
SALTS = 8
#: Fixed value: scored combinations up to which they are sent to every task.
FEW = 50_000


@dataclass(frozen=True)
class Step:
    """A task of a chain.

    name: column of its value; classes: in the order of the probabilities; features: what
    its model reads; scorers: one model, or several of which draw d takes the d-th modulo
    their number; uses: upstream step -> (feature it fills, value of each class or None for
    the class itself); observed: column of known answers, which stay as they are.
    """

    name: str
    classes: Sequence[str]
    features: Sequence[str]
    scorers: Sequence[Scorer]
    uses: dict[str, tuple[str, dict | None]] = field(default_factory=dict)
    observed: str | None = None


@dataclass(frozen=True)
class Derive:
    """A column computed on every completion from earlier values."""

    name: str
    value: Column


@dataclass
class ChainResult:
    """completions: (key, completion, weight, values); marginals: step -> (key, p); conditionals:
    step -> (key, level, p) for an enumerated step with one upstream."""

    completions: DataFrame
    marginals: dict[str, DataFrame]
    conditionals: dict[str, DataFrame]


def linear_scorer(classes: Sequence[str], intercepts: dict[str, float], terms: dict[str, dict[str, dict | float]]) -> Scorer:
    """A multinomial logistic model with given coefficients: terms[class][feature] is a
    number for a numeric feature (null counts as 0), or a number for each level (others 0)."""

    def score(df: DataFrame) -> DataFrame:
        logits = []
        for c in classes:
            z = F.lit(float(intercepts.get(c, 0.0)))
            for feature, by in terms.get(c, {}).items():
                if isinstance(by, dict):
                    part = F.lit(0.0)
                    for level, b in by.items():
                        part = F.when(F.col(feature) == level, float(b)).otherwise(part)
                    z = z + part
                else:
                    z = z + F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) * float(by)
            logits.append(F.exp(z))
        total = reduce(lambda a, b: a + b, logits)
        return df.withColumn("p", F.array(*[z / total for z in logits]))

    return score


def fitted_scorer(model, categorical: dict[str, Sequence[str]], numeric: Sequence[str] = ()) -> Scorer:
    """A fitted Spark ML classifier over what encode() makes of the features."""

    def score(df: DataFrame) -> DataFrame:
        done = model.transform(encode(df, categorical, numeric)).withColumn("p", vector_to_array("probability"))
        return done.select(*df.columns, "p")

    return score


def _combinations(d: DataFrame, names: Sequence[str], scorers: Sequence[Scorer]) -> DataFrame:
    """(_f0, _f1, ..., p): the distinct values of names (the model's number first), scored."""
    combos = d.select(*names).distinct()
    if len(scorers) > 1:
        combos = reduce(DataFrame.unionByName, [s(combos.where(F.col("_m") == k)) for k, s in enumerate(scorers)])
    else:
        combos = scorers[0](combos)
    return combos.select(*[F.col(c).alias(f"_f{k}") for k, c in enumerate(names)], "p")


def _numbered(df: DataFrame, scorers: Sequence[Scorer], which: Column | None) -> DataFrame:
    n = len(scorers)
    return df.withColumn("_m", F.lit(0) if n == 1 or which is None else F.pmod(which, F.lit(n)).cast("int"))


def _same(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f{k}")) for k, c in enumerate(names)])


def _salted(d: DataFrame, combos: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    scored = combos.withColumn("_salt2", F.explode(F.array(*map(F.lit, range(SALTS)))))
    d = d.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int"))
    return d.join(scored, _same(names) & (F.col("_salt") == F.col("_salt2"))).select(*columns, "p")


def score_distinct(df: DataFrame, features: Sequence[str], scorers: Sequence[Scorer], which: Column | None = None) -> DataFrame:
    """df with `p`: each distinct combination of features (and model) is scored once."""
    d, names = _numbered(df, scorers, which), ["_m", *features]
    return _salted(d, _combinations(d, names, scorers), names, df.columns)


def score_written(df: DataFrame, features: Sequence[str], scorers: Sequence[Scorer], which: Column | None = None, few: int = FEW) -> DataFrame:
    """score_distinct() over scores that are written first. No more than `few` of them are sent
    to every task, so that the rows stay where they are and nothing else is written; if
    there are more, rows and scores are dealt by salt and the result is written."""
    d, names = _numbered(df, scorers, which), ["_m", *features]
    combos = stage(_combinations(d, names, scorers))
    if combos.limit(few + 1).count() > few:
        return stage(_salted(d, combos, names, df.columns))
    return d.join(F.broadcast(combos), _same(names)).select(*df.columns, "p")


def _level(classes: Sequence[str], table: dict | None, value: Column) -> Column:
    """What a class fills the feature with."""
    if table is None:
        return value
    out = F.lit(None)
    for c in classes:
        out = F.when(value == c, F.lit(table[c])).otherwise(out)
    return out


def draw_class(p: Column, classes: Sequence[str], u: Column) -> Column:
    """Inverse distribution: the first class whose cumulative probability exceeds u times the total."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    ran, out = F.lit(0.0), F.lit(classes[-1])
    conditions = []
    for k, c in enumerate(classes[:-1]):
        ran = ran + F.get(p, F.lit(k))
        conditions.append((u * total < ran, c))
    for test, c in reversed(conditions):
        out = F.when(test, c).otherwise(out)
    return out


def _one_hot(step: Step, p: Column) -> Column:
    if step.observed is None:
        return p
    answer = F.array(*[(F.col(step.observed) == c).cast("double") for c in step.classes])
    return F.when(F.col(step.observed).isNotNull(), answer).otherwise(p)


def _marginal(df: DataFrame, key: str, classes: Sequence[str]) -> DataFrame:
    sums = df.groupBy(key).agg(*[F.sum(F.col("weight") * F.get("p", F.lit(k))).alias(f"_{k}") for k in range(len(classes))])
    return sums.select(key, F.array(*[F.col(f"_{k}") for k in range(len(classes))]).alias("p"))


def run_chain(
    frame: DataFrame, key: str, steps: Sequence[Step | Derive], propagation: str = "enumerate", draws: int = 1, seed: int = 0,
    given: DataFrame | None = None,
) -> ChainResult:
    """Score and propagate the steps of a chain over the rows of frame, one row a key.

    enumerate: a row is spread over the classes of every step, weights multiplied, zero
    weights dropped. draws: every draw takes a class by a reproducible uniform number of
    (key, draw, step, seed). given (draws only): (key, completion, columns) from outside,
    one row for each draw, read as features. The scores of each step are written;
    completions are not, unless a step has too many scores to send to all tasks.
    """
    if propagation not in ("enumerate", "draws"):
        raise ValueError(f"no propagation {propagation}")
    known = {s.name: s for s in steps if isinstance(s, Step)}
    for s in known.values():
        for up, (_, table) in s.uses.items():
            if up not in known or list(known).index(up) >= list(known).index(s.name):
                raise ValueError(f"{s.name} uses {up}, which is no earlier step")
            if table is not None and set(table) != set(known[up].classes):
                raise ValueError(f"{s.name}: the values of {up} do not cover its classes")
    if propagation == "draws":
        every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")))
        out = frame.withColumn("completion", every).withColumn("weight", F.lit(1.0 / draws))
        if given is not None:
            out = stage(out.join(given, [key, "completion"]))
    elif given is not None or any(len(s.scorers) > 1 for s in known.values()):
        raise ValueError("given columns and several models vary by draw: propagation must be draws")
    else:
        out = frame.withColumns({"completion": F.lit(1).cast("long"), "weight": F.lit(1.0)})
    marginals, conditionals, values = {}, {}, []
    for number, step in enumerate(steps):
        if isinstance(step, Derive):
            out = out.withColumn(step.name, step.value)
            values.append(step.name)
            continue
        filled = {feature: _level(known[up].classes, table, F.col(up)) for up, (feature, table) in step.uses.items()}
        if propagation == "enumerate" and len(step.uses) == 1:
            ((up, (feature, table)),) = step.uses.items()
            levels = sorted(set(table.values())) if table else list(known[up].classes)
            grid = frame.withColumn(feature, F.explode(F.array(*map(F.lit, levels))))
            scored = score_distinct(grid, step.features, step.scorers)
            conditionals[step.name] = scored.select(key, F.col(feature).alias("level"), _one_hot(step, F.col("p")).alias("p"))
        scored = score_written(out.withColumns(filled), step.features, step.scorers, F.col("completion") - 1)
        scored = scored.withColumn("p", _one_hot(step, F.col("p")))
        marginals[step.name] = _marginal(scored, key, step.classes)
        if propagation == "draws":
            u = uniform(F.col(key), F.col("completion"), F.lit(number), F.lit(seed))
            out = scored.withColumn(step.name, draw_class(F.col("p"), step.classes, u)).drop("p")
        else:
            arms = F.array(*[F.struct(F.lit(c).alias("c"), F.get("p", F.lit(k)).alias("q"), F.lit(k).alias("k")) for k, c in enumerate(step.classes)])
            out = scored.withColumn("_a", F.explode(F.filter(arms, lambda a: a["q"] * F.col("weight") > 0)))
            number_of = (F.col("completion") - 1) * len(step.classes) + F.col("_a.k") + 1
            out = out.withColumns({step.name: F.col("_a.c"), "weight": F.col("weight") * F.col("_a.q"), "completion": number_of.cast("long")}).drop("_a", "p")
        values.append(step.name)
    extra = [c for c in (given.columns if given is not None else ()) if c not in (key, "completion")]
    return ChainResult(out.select(key, "completion", "weight", *extra, *values), marginals, conditionals)


def value_shares(result: ChainResult, key: str, column: str) -> DataFrame:
    """(key, level, prob): weighted share of each value of a column over a row's completions."""
    return result.completions.groupBy(key, F.col(column).alias("level")).agg(F.sum("weight").alias("prob"))


def pipeline_two_levels(
    persons: DataFrame, person: str, person_steps: Sequence[Step | Derive], households: DataFrame, household: str,
    household_steps: Sequence[Step | Derive], counted: Callable[[DataFrame], Column], count: str, most: int, draws: int, seed: int,
) -> tuple[ChainResult, ChainResult]:
    """Both levels' results: draw d of the persons is counted by household (at most `most`)
    and given to draw d of the household chain as the feature `count`, on which its models
    are scored. Each level draws with a seed of its own."""
    own = run_chain(persons, person, person_steps, "draws", draws, seed)
    drawn = own.completions.join(persons.select(person, household), person)
    members = drawn.groupBy(household, "completion").agg(F.count_if(counted(drawn)).alias("_n"))
    every = households.select(household).withColumn("completion", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    given = every.join(members, [household, "completion"], "left").select(
        household, "completion", F.least(F.coalesce("_n", F.lit(0)), F.lit(most)).cast("long").alias(count)
    )
    return own, run_chain(households, household, household_steps, "draws", draws, seed + 1, given)


@dataclass(frozen=True)
class Support:
    """Levels of a feature with training support.

    shares: (level, share) of the training rows; subset: levels that rows without support
    are averaged over (all, if None); auxiliary: a model of P(level | x), with its classes,
    features and their own supports, in place of the shares.
    """

    shares: DataFrame
    subset: Sequence[str] | None = None
    auxiliary: "Auxiliary | None" = None


@dataclass(frozen=True)
class Auxiliary:
    classes: Sequence[str]
    features: Sequence[str]
    scorer: Scorer
    supports: dict[str, Support] = field(default_factory=dict)


def marginalize(
    df: DataFrame, key: str, features: Sequence[str], supports: dict[str, Support], scorer: Scorer, classes: int, most: int = 10_000, missing: str = "missing"
) -> DataFrame:
    """(key, p, features): predictions averaged over the supported levels of each feature
    whose value has no training support.

    The levels of a feature are one array, joined as a single row; nothing reaches the
    driver. Rows are spread over combinations (more than `most` is an error), the distinct
    ones scored once, and summed back. `features` names what was averaged over.
    """
    out = df.select(key, *features)
    side = {f: marginalize(df, key, s.auxiliary.features, s.auxiliary.supports, s.auxiliary.scorer, len(s.auxiliary.classes), most, missing)
            for f, s in supports.items() if s.auxiliary is not None}
    for f, found in side.items():
        out = out.join(found.select(key, F.col("p").alias(f"_aux_{f}")), key)
    for f, s in supports.items():
        kept = s.shares.where((F.col("share") > 0) & (F.col("level") != missing))
        table = kept.agg(F.sort_array(F.collect_list(F.struct("level", "share"))).alias("_lv"))
        out = out.crossJoin(F.broadcast(table))
        known = F.coalesce(F.exists("_lv", lambda x: x["level"] == F.col(f)), F.lit(False))
        over = F.col("_lv") if s.subset is None else F.filter("_lv", lambda x: x["level"].isin(*s.subset))
        if s.auxiliary is not None:
            place = F.array(*map(F.lit, s.auxiliary.classes))
            at = lambda x, p=F.col(f"_aux_{f}"), place=place: F.coalesce(F.get(p, F.array_position(place, x["level"]).cast("int") - 1), F.lit(0.0))
            over = F.transform(over, lambda x: F.struct(x["level"].alias("level"), at(x).alias("share")))
        total = F.aggregate(over, F.lit(0.0), lambda a, x: a + x["share"])
        over = F.transform(over, lambda x: F.struct(x["level"].alias("level"), (x["share"] / F.nullif(total, F.lit(0.0))).alias("share")))
        own = F.array(F.struct(F.col(f).alias("level"), F.lit(1.0).alias("share")))
        out = out.withColumns({f"_to_{f}": F.when(known, own).otherwise(over), f"_no_{f}": F.when(~known, f)}).drop("_lv")
    sizes = reduce(lambda a, b: a * b, [F.size(f"_to_{f}").cast("double") for f in supports], F.lit(1.0))
    fits = F.when(sizes > most, F.raise_error(F.concat(F.lit(f"more than {most} combinations of levels for "), F.col(key).cast("string")))).otherwise(F.lit(1.0))
    out = out.withColumn("_w", fits.cast("double"))
    for f in supports:
        out = out.withColumn("_x", F.explode(f"_to_{f}")).withColumns({f: F.col("_x.level"), "_w": F.col("_w") * F.col("_x.share")}).drop("_x", f"_to_{f}")
    scored = score_distinct(out, features, [scorer])
    names = F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *[F.col(f"_no_{f}") for f in supports])), "+")
    sums = scored.groupBy(key).agg(*[F.sum(F.col("_w") * F.get("p", F.lit(k))).alias(f"_{k}") for k in range(classes)], F.first(names).alias("features"))
    return sums.select(key, F.array(*[F.col(f"_{k}") for k in range(classes)]).alias("p"), "features")
