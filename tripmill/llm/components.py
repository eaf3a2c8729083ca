"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROUNDS = 60
#: Centres of more links than HOT_STAR meet their least neighbour in SALTS parts.
HOT_STAR, SALTS = 4096, 32


def _beside_least(edges: DataFrame) -> DataFrame:
    """(a, b, m) of edges (a, b): m is the least neighbour of a."""
    low = stage(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    hot = low.where(F.col("n") > HOT_STAR)
    low = low.select("a", "m")
    if hot.isEmpty():
        return edges.join(low, "a").select("a", "b", "m")
    spread = hot.select("a", F.lit(True).alias("hot"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    marked = stage(dealt.join(spread, ["a", "salt"], "left").select("a", "b", "hot", "m"))
    rest = marked.where("hot IS NULL").select("a", "b").join(low, "a").select("a", "b", "m")
    return rest.union(marked.where("hot").select("a", "b", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _beside_least(both).where("b > a").withColumn("m", F.least("m", "a"))
    return least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _beside_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    moved = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(down.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all components are stars: every node has one root, and no root has another."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the least node it reaches.

    edges has two long columns a and b. Every round is written to the checkpoint
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = stage(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        now = stage(_small_star(_large_star(now)))
        if _settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )
