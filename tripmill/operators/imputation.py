"""Draws, completions and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) of the values of parts, whatever the partitions."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assign_arms(df: DataFrame, arms: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """The first model whose required features are all observed; null if none is."""
    arm = F.lit(None).cast("string")
    for name, needed in reversed(arms):
        observed = F.lit(True)
        for c in needed:
            observed = observed & F.col(c).isNotNull()
        arm = F.when(observed, name).otherwise(arm)
    return df.withColumn("arm", arm)


def pick(probabilities: Sequence[Column], labels: Sequence[str], u: Column) -> Column:
    """Inverse distribution: the first label whose cumulative probability exceeds u."""
    total, out = F.lit(0.0), None
    for p, label in zip(probabilities[:-1], labels[:-1]):
        total = total + p
        out = F.when(u < total, label) if out is None else out.when(u < total, label)
    return out.otherwise(labels[-1]) if out is not None else F.lit(labels[-1])


def chain_draws(df: DataFrame, key: str, draws: int, seed: int, steps: Sequence[tuple[str, Sequence[str], dict | None]]) -> DataFrame:
    """One row per row and draw; each step draws a class from probabilities that may
    depend on the class drawn before it.

    A step is (column, labels, given): given maps a class of the step before to the
    probability columns, or holds them under None for the first step.
    """
    out = df.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    before = None
    for number, (name, labels, given) in enumerate(steps):
        u = uniform(F.col(key), F.col("draw"), F.lit(number), F.lit(seed))
        value = F.lit(None).cast("string")
        for known, columns in given.items():
            drawn = pick([F.col(c) for c in columns], labels, u)
            value = drawn if known is None else F.when(F.col(before) == known, drawn).otherwise(value)
        out, before = out.withColumn(name, value), name
    return out


def chain_enumerate(df: DataFrame, key: str, upstream: dict[str, str], given: dict[str, str]) -> DataFrame:
    """(key, marginal, scenarios, names): the downstream probability over all upstream
    classes; upstream maps a class to its probability column, given to the downstream
    one. Classes of probability zero are dropped."""
    arms = F.array(*[F.struct(F.lit(k).alias("name"), F.col(p).alias("w"), F.col(given[k]).alias("p")) for k, p in upstream.items()])
    live = F.filter(arms, lambda a: a["w"] > 0)
    marginal = F.aggregate(live, F.lit(0.0), lambda s, a: s + a["w"] * a["p"])
    names = F.array_join(F.transform(live, lambda a: a["name"]), "+")
    return df.select(key, marginal.alias("marginal"), F.size(live).cast("long").alias("scenarios"), names.alias("names"))


def level_per_draw(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """(keys, level, prob): share of the draws of a row at each level."""
    counts = df.groupBy(*keys, level).agg(F.count("*").alias("n"))
    return counts.select(*keys, level, (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("prob"))


def points(df: DataFrame, tables: dict[str, dict[str, int]], cuts: Sequence[tuple[int, str]], top: str) -> DataFrame:
    """points: sum of the points of each column's value (an unlisted value makes it
    null); level: the first cut above the points."""
    total = None
    for column, table in tables.items():
        p = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)]
        total = p if total is None else total + p
    level = F.lit(top)
    for bound, name in reversed(cuts):
        level = F.when(F.col("points") < bound, name).otherwise(level)
    return df.withColumn("points", total.cast("long")).withColumn("level", F.when(F.col("points").isNotNull(), level))


def grouped_split(df: DataFrame, group: str, target: str, folds: int, seed: int) -> DataFrame:
    """(group, fold): groups dealt over folds within their most common class, in the
    order of a hash of the group; all rows of a group share its fold."""
    counts = df.groupBy(group, target).agg(F.count("*").alias("n"))
    dominant = counts.groupBy(group).agg(F.max_by(F.struct(target), F.struct("n", -F.col(target))).alias("d")).select(group, f"d.{target}")
    h = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed))))
    # A number within blocks of the hash, so that a class with most groups is not one window.
    deal = Window.partitionBy(target, F.substring(h, 1, 2)).orderBy(h, group)
    return dominant.select(group, ((F.row_number().over(deal) - 1) % folds).cast("long").alias("fold"))


def bad_probability_rows(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """(rows, bad): rows whose probabilities are not finite or do not sum to one."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    good = F.coalesce(~F.isnan(total) & (F.abs(total - 1) <= tolerance), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count(F.when(~good, 1)).alias("bad"))


def cluster_bootstrap(groups: DataFrame, group: str, dense_id: str, n: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, times): n groups drawn with replacement for each replicate; to
    weight rows with, instead of copying them. dense_id numbers the groups from 0."""
    spark = groups.sparkSession
    slots = spark.range(n * replicates).select((F.floor(F.col("id") / n) + 1).alias("replicate"), (F.col("id") % n).alias("slot"))
    drawn = slots.select("replicate", F.floor(uniform(F.col("replicate"), F.col("slot"), F.lit(seed)) * n).cast("long").alias(dense_id))
    times = drawn.groupBy("replicate", dense_id).agg(F.count("*").alias("times"))
    return times.join(groups.select(group, dense_id), dense_id).select("replicate", group, "times")


def usage(df: DataFrame, model: str, weight: str) -> DataFrame:
    """(model, rows, weight, share) of each model used."""
    out = df.groupBy(model).agg(F.count("*").alias("rows"), F.sum(weight).alias("total"))
    return out.crossJoin(F.broadcast(df.agg(F.sum(weight).alias("whole")))).select(model, "rows", "total", (F.col("total") / F.col("whole")).alias("share"))


def most_probable(columns: Sequence[str]) -> Column:
    """Position (from 1) of the largest probability, the first on ties."""
    every = F.array(*columns)
    return F.array_position(every, F.array_max(every))


def variant_agreement(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(rows, agreement): share of the common rows with the same most probable class."""
    both = a.select(key, most_probable(columns).alias("a")).join(b.select(key, most_probable(columns).alias("b")), key)
    return both.agg(F.count("*").alias("rows"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def rubin(df: DataFrame, by: str, estimate: str, variance: str) -> DataFrame:
    """(by, m, mean, within, between, total, df): estimates of completed datasets pooled
    by Rubin's rules; df is null where the estimates do not differ."""
    out = df.groupBy(by).agg(
        F.count("*").alias("m"), F.avg(estimate).alias("mean"), F.avg(variance).alias("within"), F.var_samp(estimate).alias("between")
    )
    extra = (1 + 1 / F.col("m")) * F.col("between")
    return out.withColumn("total", F.col("within") + extra).withColumn(
        "df", F.when(F.col("between") > 0, (F.col("m") - 1) * F.pow(1 + F.col("within") / extra, 2))
    )


def draw_spread(df: DataFrame, draw: str, level: str, weight: str) -> DataFrame:
    """(level, mean, sd): spread over the draws of the weighted share of each level; a
    level that a draw lacks counts as zero there."""
    cells = df.groupBy(draw, level).agg(F.sum(weight).alias("w"))
    share = cells.withColumn("s", F.col("w") / F.sum("w").over(Window.partitionBy(draw)))
    n = F.broadcast(df.agg(F.count_distinct(draw).alias("n")))
    out = share.groupBy(level).agg(F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("b")).crossJoin(n)
    mean = F.col("a") / F.col("n")
    var = F.greatest((F.col("b") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))
    return out.select(level, mean.alias("mean"), F.sqrt(var).alias("sd"))


def marginal_log_loss(df: DataFrame, level: str, weight: str) -> DataFrame:
    """(log_loss): of the weighted class shares, taken as everyone's prediction."""
    cells = df.groupBy(level).agg(F.sum(weight).alias("w"))
    return cells.agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.log("w")).alias("e")).select((F.log("t") - F.col("e") / F.col("t")).alias("log_loss"))


def build_task_frame(source: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], target: str, slugs: dict[str, str]) -> DataFrame:
    """source with the features of parts (each by its keys, one row a key), the target as the
    slug of its label, and `unknown` where there is no answer; an unlisted label is an error."""
    odd = source.where(F.col(target).isNotNull() & ~F.col(target).isin(*slugs)).select(target).distinct().limit(10).collect()
    if odd:
        raise ValueError(f"{target}: unlisted {sorted(str(r[0]) for r in odd)}")
    table = F.create_map(*[F.lit(x) for kv in slugs.items() for x in kv])
    out = source.withColumn("unknown", F.col(target).isNull()).withColumn(target, table[F.col(target)])
    for df, keys in parts:
        out = out.join(df, list(keys), "left")
    return out


def chain_expected(df: DataFrame, key: str, probabilities: dict[str, str], scores: dict[str, float]) -> DataFrame:
    """(key, expected): sum of each class's probability times its score."""
    total = sum((F.col(p) * float(scores[c]) for c, p in probabilities.items()), F.lit(0.0))
    return df.select(key, total.alias("expected"))


def join_names_over_scenarios(df: DataFrame, key: str, names: str) -> DataFrame:
    """(key, names): the distinct '+'-joined names of all rows of a key, sorted."""
    one = df.select(key, F.explode(F.split(names, r"\+")).alias("_n")).where("_n <> ''").distinct()
    found = one.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_n")), "+").alias(names))
    return df.select(key).distinct().join(found, key, "left").na.fill("", [names])


def pipeline_two_levels(
    persons: DataFrame, households: DataFrame, person: str, household: str, draws: int, seed: int,
    person_step: tuple[str, Sequence[str], dict], counted: str, household_step: tuple[str, Sequence[str], dict], most: int,
) -> DataFrame:
    """(household, draw, members, class): draw d of the persons' classes feeds draw d of the
    household's: the members drawn as `counted`, at most `most`, choose the probability
    columns of the household step."""
    own = chain_draws(persons, person, draws, seed, [person_step])
    members = own.groupBy(household, "draw").agg(F.count_if(F.col(person_step[0]) == counted).alias("members"))
    every = households.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    out = every.join(members, [household, "draw"], "left").na.fill(0, ["members"]).withColumn("members", F.least("members", F.lit(most)).cast("long"))
    name, labels, given = household_step
    u = uniform(F.col(household), F.col("draw"), F.lit(1), F.lit(seed))
    value = F.lit(None).cast("string")
    for n, columns in given.items():
        value = F.when(F.col("members") == n, pick([F.col(c) for c in columns], labels, u)).otherwise(value)
    return out.select(household, "draw", "members", value.alias(name))


def usage_details(df: DataFrame, model: str, weight: str, confidence: str, features: str) -> DataFrame:
    """(model, features, rows, total, share, low, mean, high): by model used and set of
    marginalised features, the rows, their weight and its share, and the least, weighted
    mean and greatest confidence."""
    w = F.col(weight)
    out = df.groupBy(model, features).agg(
        F.count("*").alias("rows"), F.sum(w).alias("total"), F.min(confidence).alias("low"), (F.sum(w * F.col(confidence)) / F.sum(w)).alias("mean"), F.max(confidence).alias("high")
    )
    return out.crossJoin(F.broadcast(df.agg(F.sum(w).alias("whole")))).withColumn("share", F.col("total") / F.col("whole")).drop("whole")
