"""URL block and allow lists by hashed host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits its host and all subdomains if the url's path
starts with the rule's path; the longest fitting rule decides. Every url is expanded to
its host suffixes times its path prefixes of the lengths that occur in rules; the short
hash prefix of each expression is equi-joined with the rules', and the full digest
confirms the match. Native expressions only.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict. Repeated urls are judged row by row. Of rules that
fit with equal length, the longer host wins, then ``block``. A rule table without rows
leaves every url at the default. Rules that repeat a host and path count once, ``block``
before ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this count are broadcast (about 100 bytes each); beyond it the join
#: shuffles, with the url side salted.
BROADCAST_RULES = 200_000
SALTS = 16
#: Distinct (labels of a host, length of a path) pairs that rules may have.
MAX_SHAPES = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def compile_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict, labels, path_len, short (32-bit hash prefix), digest."""
    rule = F.concat(F.col("host"), F.col("path"))
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    return (
        rules.where("host IS NOT NULL AND host <> '' AND verdict IN ('allow', 'block')")
        .select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            rule.alias("rule"),
            "verdict",
            F.length("host").alias("host_len"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            F.length("path").alias("path_len"),
            _digest(F.concat_ws("\n", "host", "path")).alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, 8))
    )


def filter_urls(
    urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of urls.

    The urls are never shuffled by host: with few rules the join is a broadcast; with
    many, both sides are dealt by (short prefix, salt). The best rule of a url is then
    a maximum per row id, mostly combined before the shuffle, so a host with a third of
    all urls is no hot key.
    """
    compiled = compile_rules(rules)
    shapes = compiled.groupBy("labels", "path_len").count().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"rules have more than {MAX_SHAPES} shapes of host and path")
    n_rules = sum(r["count"] for r in shapes)
    base = urls.select(
        F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    if not n_rules:
        return base.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shape = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["path_len"]).alias("path_len")) for r in sorted(shapes)])
    labels = F.split("host", r"\.", -1)
    fitting = F.filter(
        shape, lambda s: (F.size(labels) >= s["labels"]) & (F.length("path") >= s["path_len"]) & (F.col("host") != "")
    )
    expressions = F.transform(
        fitting,
        lambda s: _digest(
            F.concat(
                F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."),
                F.lit("\n"),
                F.substring(F.col("path"), F.lit(1), s["path_len"]),
            )
        ),
    )
    left = (
        base.withColumn("row", F.monotonically_increasing_id())
        .withColumn("digest", F.explode_outer(expressions))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    hit = F.struct(F.length("rule").alias("len"), "host_len", F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))
    right = compiled.select(F.col("short").alias("r_short"), F.col("digest").alias("r_digest"), hit.alias("hit"))
    near = F.col("short") == F.col("r_short")
    if n_rules <= broadcast_rules:
        joined = left.join(F.broadcast(right), near, "left")
    else:
        left = left.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)))
        right = right.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, near & (F.col("salt") == F.col("r_salt")), "left")
    confirmed = F.when(F.col("digest") == F.col("r_digest"), F.col("hit"))
    return (
        joined.groupBy("row")
        .agg(*[F.first(c).alias(c) for c in (key, "host", "path")], F.max(confirmed).alias("best"))
        .select(
            key, "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )
