"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint holds the majority of each bit over the XXH64 (seed 42) of its word
shingles, repeats included. Texts link when their fingerprints differ in at most
`distance` bits. Cut into `blocks` blocks, two such fingerprints agree wholly on at least
blocks - distance of them, so they meet in one of the tables keyed by that many blocks;
there their Hamming distance is verified.

Equal fingerprints count once before any join. A table's bucket hands on a spanning
forest of its links, never all pairs; a bucket of more than BUCKET_LIMIT fingerprints,
found by a pre-aggregated count, is dealt anew by parts of its remaining bits (pigeonhole
again, so no link is lost) until it is small, which the number of bits left over assures.

Defined cases: a null or blank text has the fingerprint zero and links like any other;
fewer words than a shingle count as one shingle. Rows that repeat a doc_id are one
document to the component; a null doc_id gets its component but never names one. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, tidy
from .components import components

BUCKET_LIMIT, HOT_CLASS, SALTS = 2048, 4096, 32
_CHUNK = 100_000


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        part = words[lo : min(lo + _CHUNK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks of the 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _finer(mask: int, distance: int) -> list[int]:
    """mask with one of distance + 1 parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * k // (distance + 1) for k in range(distance + 2)]
    return [mask | sum(1 << b for b in free[cut[k] : cut[k + 1]]) for k in range(distance + 1)]


def _forest(distance: int):
    """Rows sorted by (mask, bucket, fp) to spanning forests of each bucket's links."""

    def links(fp: np.ndarray, run: np.ndarray) -> tuple[list[int], list[int]]:
        parent = list(range(len(fp)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        a, b = [], []
        u = fp.view(np.uint64)
        for k in range(1, len(fp)):
            same = run[k:] == run[:-k]
            if not same.any():
                break
            near = np.flatnonzero(same & (np.bitwise_count(u[k:] ^ u[:-k]) <= distance))
            for i in near.tolist():
                x, y = find(i), find(i + k)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(int(fp[i]))
                    b.append(int(fp[i + k]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            change = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else np.empty(0, bool)
            a, b = links(np.ascontiguousarray(rows[:, 2]), np.cumsum(change))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out(rows[:cut])
            held = rows[cut:]
        if len(held):
            yield out(held)

    return run


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct links (a, b) whose transitive closure equals that of all links within
    distance. fps: one column fp of distinct longs."""
    spark: SparkSession = fps.sparkSession
    masks = block_masks(blocks, distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        keyed = keyed.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        large = stage(keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("mask", "bucket"))
        whole = large.isEmpty()
        if not whole:  # salted, so that the rows of a large bucket are never in one task
            salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
            apart = large.withColumn("large", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            keyed = stage(keyed.withColumn("salt", salt).join(apart, ["mask", "bucket", "salt"], "left").drop("salt"))
        bucket = Window.partitionBy("mask", "bucket")
        small = (
            (keyed if whole else keyed.where("large IS NULL")).select("mask", "bucket", "fp")
            .withColumn("n", F.count("*").over(bucket)).where("n > 1").select("mask", "bucket", "fp")
            .sortWithinPartitions("mask", "bucket", "fp")
            .mapInArrow(tidy(_forest(distance)), "a long, b long")
        )
        found = small if found is None else found.union(small)
        if whole:
            return found.distinct()
        # Free bits shrink by a quarter each round, so this ends: 2 ** free is a bound.
        finer = [(m, f) for m in masks for f in _finer(m, distance)]
        masks = sorted({f for _, f in finer})
        steps = spark.createDataFrame([(_signed(m), _signed(f)) for m, f in finer], "mask long, finer long")
        keyed = (
            keyed.where("large").join(F.broadcast(steps), "mask").select("fp", F.col("finer").alias("mask")).distinct()
        )


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the smallest
    doc_id reachable over links."""
    return _named(stage(fingerprints(docs, width)), distance, blocks)


def _named(fps: DataFrame, distance: int, blocks: int, more: DataFrame | None = None) -> DataFrame:
    """near_duplicates of stored fingerprints, linked further by more (a, b)."""
    near = links(fps.select("fp").distinct(), distance, blocks)
    return name_components(fps, near if more is None else near.union(more))


def name_components(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of stored rows (doc_id, fp) over links of fp. Classes of more
    than HOT_CLASS documents meet their names salted."""
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(edges)
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("low").alias("least"))
    label = linked.join(least, "root").select("fp", "least")
    names = stage(classes.join(label, "fp", "left").select("fp", "n", F.coalesce("least", "low").alias("component_id")))
    hot = names.where(F.col("n") > HOT_CLASS)
    if hot.isEmpty():
        return fps.join(names, "fp").select("doc_id", "fp", "component_id")
    hot = hot.select("fp", F.lit(True).alias("hot"), F.col("component_id").alias("named"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = fps.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(hot, ["fp", "salt"], "left")
    marked = stage(marked.select("doc_id", "fp", "hot", "named"))
    rest = marked.where("hot IS NULL").join(names, "fp").select("doc_id", "fp", "component_id")
    return rest.union(marked.where("hot").select("doc_id", "fp", "named"))


def one_of_each(docs: DataFrame, width: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """The rows of docs whose doc_id names its component, one row for each such id (of
    rows that repeat an id, the one whose text hashes lowest), and rows without an id."""
    return _firsts(docs, near_duplicates(docs, width, distance, blocks))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    named = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    first = Window.partitionBy("id").orderBy("h")
    stay = rows.join(named, "id", "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1")
    return stay.select("doc.*").unionByName(docs.where("doc_id IS NULL"))
