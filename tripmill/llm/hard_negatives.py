"""Hard-negative mining with an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a pair of codewords is a cell.
For an anchor, the inner product with any row of a cell is at most the sum, over the
halves, of <anchor half, codeword> + |anchor half| * radius, the radius being the largest
distance of a member from its codeword. A heap over the two sorted lists of half bounds
(multi-sequence) visits cells by their summed bound and stops as soon as no unvisited cell
can change what was asked: the first rows of the same label (positives), or, for each
positive, the first rows of other labels within its score window. Results are exact.

How it is spread: rows of equal vector and label become one class with its smallest ids
(more can never be asked for), so frequent vectors are no hot group. Classes are dealt by
ranges of cell and hash, so a large cell is split over partitions. Anchors, searched for
once per class, go round in blocks of bounded size by broadcast. Two waves answer a block:
the first visits each anchor's best cells only and gives floors, the second visits whatever
cell the floors do not exclude. Every task keeps the best k per question, which are merged
by (anchor, window).

Defined cases: rows with a null id, label or vector, with a null or non-finite component,
or one of magnitude 2^19 and more (scores must fit a long) take no part. Shorter vectors
count as filled up with zeros. Repeated rows (id, label and vector equal) count once; a row
of the anchor's id but another label or vector is another row. Ties go to the smaller id.
An empty table, or one without anchors, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_dir, partitions, small_batches, stage, tidy

#: Rows read to fit the codebooks, those of the smallest hashes.
SAMPLE = 20_000
#: Anchor classes sent round at once, on average.
BLOCK = 2_048
#: Classes of one local index; a task holds one at a time.
CHUNK = 16_384
#: Classes of one partition of the index.
PART = 65_536
#: Rows scored at once, so that few cells do not mean many small products.
STEP = 1_024
#: Rows that the first wave looks at for each anchor.
FIRST = 4_096
#: Copies of an answer, so that anchors of one frequent vector are spread.
SALTS = 8
LIMIT = float(1 << 19)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label (as text), vec (whole numbers, cut toward minus infinity), qid of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LIMIT))
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"),
        F.when(fine, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))).alias("vec"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return rows.withColumn("qid", F.sha2(F.to_json(F.struct("label", "vec")), 256))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct (label, vec) with their `keep` smallest ids in order; the limit is applied
    before the shuffle too."""
    one = rows.dropDuplicates(["vec_id", "qid"])
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("vec_id"))).where(F.col("n") <= keep)
    return ranked.groupBy("qid").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit_codebooks(x: np.ndarray, codewords: int, rounds: int = 8) -> list[np.ndarray]:
    """Two codebooks by Lloyd's rounds over the halves of the sample x."""
    books, cut = [], x.shape[1] // 2
    for half in (x[:, :cut], x[:, cut:]):
        rng = np.random.default_rng(0)
        distinct = np.unique(half, axis=0)
        book = distinct[rng.permutation(len(distinct))[:codewords]].astype(float)
        for _ in range(rounds):
            near = nearest(half, book)[0]
            for k in range(len(book)):
                if (near == k).any():
                    book[k] = half[near == k].mean(axis=0)
        books.append(book)
    return books


def nearest(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row and its distance."""
    code = ((book**2).sum(axis=1) - 2 * half @ book.T).argmin(axis=1)
    return code, np.sqrt(((half - book[code]) ** 2).sum(axis=1))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if len(n) and (n == dim).all():
        out[:] = flat.reshape(len(column), dim)
    else:
        out[np.arange(dim) < n[:, None]] = flat
    return out


def visit_order(b1: np.ndarray, b2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all cells by falling b1[i] + b2[j]: the multi-sequence heap, which
    opens a cell only when its neighbour above or to the left was visited."""
    o1, o2 = np.argsort(-b1, kind="stable"), np.argsort(-b2, kind="stable")
    s1, s2 = b1[o1].tolist(), b2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap = [(-(s1[0] + s2[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, o1[i], o2[j]
        if j + 1 < len(s2):
            heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))


class Question:
    """First k rows in order of (score falling, id) with low <= score <= high; `best` are
    those found so far, `floor` the least score that can still matter."""

    __slots__ = ("key", "k", "low", "high", "floor", "best")

    def __init__(self, key: int, k: int, low: float, high: float, floor: float):
        self.key, self.k, self.low, self.high, self.floor, self.best = key, k, low, high, max(low, floor), []

    def add(self, scores: np.ndarray, rows: np.ndarray, ids: list, own: int) -> None:
        fit = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if not len(fit):
            return
        if len(fit) > self.k:  # a row has an id at least, so k rows above a score suffice
            least = np.partition(scores[fit], len(fit) - self.k)[len(fit) - self.k]
            fit = fit[scores[fit] >= least]
        found = [(-int(scores[f]), i, int(rows[f]) == own) for f in fit.tolist() for i in ids[rows[f]]]
        self.best = heapq.nsmallest(self.k, [*self.best, *found])
        if len(self.best) == self.k:
            self.floor = max(self.floor, -self.best[-1][0])


class LocalIndex:
    """The cells of one chunk of classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: list, books: list[np.ndarray]):
        cut = x.shape[1] // 2
        codes, far = zip(*(nearest(h, b) for h, b in zip((x[:, :cut], x[:, cut:]), books)))
        order = np.lexsort((codes[1], codes[0]))
        self.x, self.labels, self.ids = x[order], labels[order], [ids[k] for k in order.tolist()]
        c1, c2 = codes[0][order], codes[1][order]
        self.words = [np.unique(c) for c in (c1, c2)]
        self.radii = [np.array([far[h][codes[h] == w].max() for w in self.words[h]]) for h in (0, 1)]
        self.books = [books[h][self.words[h]] for h in (0, 1)]
        cells, begin = np.unique(c1 * len(books[1]) + c2, return_index=True)
        ends = np.append(begin[1:], len(x))
        self.cells = {(int(c) // len(books[1]), int(c) % len(books[1])): (int(a), int(b)) for c, a, b in zip(cells, begin, ends)}
        self.peak = float(np.abs(x).max()) if x.size else 0.0

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.peak * np.abs(q).sum() < 2**53:
            return self.x[at] @ q
        return self.x[at].astype(np.int64) @ q.astype(np.int64)

    def ask(self, q: np.ndarray, label: int, same: bool, questions: list[Question], first: set | None, skip: set) -> int:
        """Answer questions for the anchor q; visit only the cells in first, if given, and
        none of skip. Returns the number of rows scored."""
        cut, done = len(q) // 2, 0
        halves = (q[:cut], q[cut:])
        bounds = [self.books[h] @ halves[h] + math.sqrt(float(halves[h] @ halves[h])) * self.radii[h] for h in (0, 1)]
        slack = 0.5 + 1e-9 * (np.abs(q).sum() * self.peak)
        queued, size = [], 0

        def flush() -> None:
            at = np.concatenate([np.arange(a, b) for a, b in queued])
            at = at[(self.labels[at] == label) == same]
            s = self.scores(at, q)
            own = -1
            if same:
                equal = np.flatnonzero((self.x[at] == q).all(axis=1))
                own = int(at[equal[0]]) if len(equal) else -1
            for question in questions:
                question.add(s, at, self.ids, own)

        for bound, i, j in visit_order(*bounds):
            cell = (int(self.words[0][i]), int(self.words[1][j]))
            if all(bound + slack < question.floor for question in questions):
                break
            span = self.cells.get(cell)
            if span is None or cell in skip or (first is not None and cell not in first):
                continue
            queued.append(span)
            size += span[1] - span[0]
            if size >= STEP:
                flush()
                done, queued, size = done + size, [], 0
        if queued:
            flush()
        return done + size


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def search(index: DataFrame, asked, books, dim: int, same: bool, k: int, second: bool) -> DataFrame:
    """q, key, score, id, own for each question: the k best of every task.

    asked: broadcast list of (vector, label, first cells, [(key, low, high, floor)]).
    second: visit all cells but the first ones, otherwise only these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (b1, b2) = asked.value, books.value
        open_ = [[Question(key, k, *rest) for key, *rest in questions] for _, _, _, questions in anchors]
        for t in _chunks(batches):
            col = lambda name: t.column(name).combine_chunks()
            coded = col("label").dictionary_encode()
            known = {v: n for n, v in enumerate(coded.dictionary.to_pylist())}
            local = LocalIndex(matrix(col("vec"), dim), coded.indices.to_numpy(), col("ids").to_pylist(), [b1, b2])
            for (q, label, first, _), questions in zip(anchors, open_):
                if questions:
                    local.ask(q, known.get(label, -1), same, questions, None if second else first, first if second else set())
        out = [(n, w.key, -s, i, own) for n, ws in enumerate(open_) for w in ws for s, i, own in w.best]
        n, key, s, i, own = zip(*out) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.int64()), pa.array(own, pa.bool_())],
            names=["q", "key", "score", "id", "own"],
        )

    return index.select("label", "vec", "ids").mapInArrow(tidy(run), "q int, key long, score long, id long, own boolean")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k first of each question, ranked from 1."""
    w = Window.partitionBy("q", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def _two_waves(index: DataFrame, anchors: list, questions: list, k: int, same: bool, books, dim: int) -> DataFrame:
    """The k best of every question over the whole index, staged."""
    sc = index.sparkSession.sparkContext
    asked = sc.broadcast([(*a, w) for a, w in zip(anchors, questions)])
    first = stage(search(index, asked, books, dim, same, k, second=False))
    # The k-th best of the first wave is a floor for the second: one number a question.
    floors = {(r["q"], r["key"]): r["score"] for r in _best(first, k).where(F.col("n") == k).select("q", "key", "score").collect()}
    again = [[(key, low, high, floors.get((n, key), floor)) for key, low, high, floor in w] for n, w in enumerate(questions)]
    told = sc.broadcast([(*a, w) for a, w in zip(anchors, again)])
    rest = search(index, told, books, dim, same, k, second=True)
    out = stage(_best(first.union(rest), k).select("q", "key", "score", "id", "own", "n"))
    asked.unpersist()
    told.unpersist()
    return out


def first_cells(q: np.ndarray, books: list[np.ndarray], radii: list[np.ndarray], counts: dict) -> set:
    """The anchor's best cells, until they hold FIRST classes."""
    cut, seen, cells = len(q) // 2, 0, set()
    bounds = [b @ h + math.sqrt(float(h @ h)) * r for b, h, r in zip(books, (q[:cut], q[cut:]), radii)]
    for _, i, j in visit_order(*bounds):
        if (i, j) in counts:
            cells.add((i, j))
            seen += counts[i, j]
            if seen >= FIRST:
                break
    return cells


def build_index(classes: DataFrame, codewords: int) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray], dict, int]:
    """(classes dealt by cell, codebooks, radii, classes per cell, dimensions).

    The codebooks are fitted on SAMPLE classes at most, those of the smallest hashes; every
    class is indexed. Counts and radii are a table of codewords^2 rows at most.
    """
    spark = classes.sparkSession
    total, dim = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(dim or 0, 2)
    sample = classes.select("qid", "vec").orderBy("qid").limit(SAMPLE).toArrow().column("vec").combine_chunks()
    books = fit_codebooks(matrix(sample, dim), codewords)
    held = spark.sparkContext.broadcast(books)
    cut = dim // 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vec")), dim)
            parts = [nearest(h, b) for h, b in zip((x[:, :cut], x[:, cut:]), held.value)]
            more = [pa.array(parts[0][0], pa.int32()), pa.array(parts[1][0], pa.int32()), pa.array(parts[0][1]), pa.array(parts[1][1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "c1", "c2", "d1", "d2"])

    more = [("c1", T.IntegerType()), ("c2", T.IntegerType()), ("d1", T.DoubleType()), ("d2", T.DoubleType())]
    schema = T.StructType([*classes.schema, *(T.StructField(*m) for m in more)])
    coded = classes.mapInArrow(tidy(assign), schema)
    parts = max(partitions(spark), math.ceil(total / PART))
    index = stage(coded.repartitionByRange(parts, "c1", "c2", "qid"))
    cells = index.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect()
    radii = [np.zeros(len(b)) for b in books]
    for r in cells:
        radii[0][r["c1"]] = max(radii[0][r["c1"]], r["d1"])
        radii[1][r["c2"]] = max(radii[1][r["c2"]], r["d2"])
    return index, books, radii, {(r["c1"], r["c2"]): r["n"] for r in cells}, dim


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    codewords: int = 16,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; anchors: condition on vec_id and label. An anchor's
    positives are its first `positives` other rows of its label; the negatives of either
    are the first `negatives` rows of other labels whose score is within low and high
    hundredths of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable_rows(vectors, scale)
    classes = stage(classes_of(rows, max(positives + 1, negatives)))
    marked = stage(rows.where(anchors).select("vec_id", "qid").dropDuplicates())
    wanted = stage(classes.join(marked.select("qid").distinct(), "qid", "left_semi").select("qid", "label", "vec"))
    n_wanted = wanted.count()
    if not n_wanted:
        return spark.createDataFrame([], RESULT)
    index, books, radii, counts, dim = build_index(classes, codewords)
    held = spark.sparkContext.broadcast(books)
    blocks = math.ceil(n_wanted / BLOCK)
    path = f"{checkpoint_dir(spark)}/tripmill-{uuid.uuid4().hex}"
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        x = matrix(part.column("vec").combine_chunks(), dim) if part.num_rows else []
        asked = [(q, label, first_cells(q, books, radii, counts)) for q, label in zip(x, part.column("label").to_pylist())]
        open_ = [[(0, -math.inf, math.inf, -math.inf)] for _ in asked]
        near = _two_waves(index, asked, open_, positives + 1, True, held, dim)
        scores: list[set[int]] = [set() for _ in asked]
        for r in near.select("q", "score").distinct().toLocalIterator():
            scores[r["q"]].add(r["score"])
        # low * positive <= 100 * negative <= high * positive, in whole numbers
        windows = [[(s, -(-low * s // 100), high * s // 100, -math.inf) for s in sorted(w)] for w in scores]
        windows = [[w for w in ws if w[1] <= w[2]] for ws in windows]
        far = _two_waves(index, asked, windows, negatives, False, held, dim)
        by_window = far.groupBy("q", F.col("key").alias("score")).agg(
            F.sort_array(F.collect_list(F.struct("n", "id", F.col("score").alias("s")))).alias("negatives")
        )
        names = spark.createDataFrame(list(enumerate(part.column("qid").to_pylist())), "q int, qid string")
        answers = near.join(by_window, ["q", "score"], "left").groupBy("q").agg(
            F.sort_array(F.collect_list(F.struct("n", "id", "score", "own", "negatives"))).alias("near")
        )
        answers.join(F.broadcast(names), "q").select("qid", "near").write.mode("append").parquet(path)
    held.unpersist()
    answers = spark.read.schema(
        "qid string, near array<struct<n:int,id:bigint,score:bigint,own:boolean,negatives:array<struct<n:int,id:bigint,s:bigint>>>>"
    ).parquet(path)
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = marked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(salted, ["qid", "salt"])
    other = F.filter("near", lambda p: ~(p["own"] & (p["id"] == F.col("vec_id"))))
    pairs = pairs.select("vec_id", F.explode(F.slice(other, 1, positives)).alias("p"))
    flat = pairs.select("vec_id", "p.id", "p.score", F.explode("p.negatives").alias("x"))
    return flat.select(
        F.col("vec_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("x.n").cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("x.s").alias("negative_score"),
    )
