"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus (2 ** BITS counters).
2. A randomised SVD of the TF-IDF matrix of benchmark passages, its products with the
   distributed rows summed by Spark, gives each hashed word a latent vector. The index is
   fitted on at most FIT_PASSAGES passages, in order of the hash of their text; a passage's
   word outside the fitted ones has a random vector, so that every passage is projected
   and searched for.
3. Every window of two STEPs of words of every whole text is projected; a cosine with a
   benchmark passage of `cosine` or more makes a candidate, however many there are, if
   the window also holds COVERAGE of the passage's own length in that space.
4. A candidate counts if the longest common subsequence of words with the text around
   the window holds `lcs` of the passage, or `lcs_with_answer` of it and the passage's
   answer (the column `answer`, else its last words) stands there verbatim.

The benchmark is the query set: it is searched in blocks of about BLOCK_ITEMS passages, so
what is broadcast or held by the driver at once is bounded; a block's broadcast goes when
its part of the result is written. With one block texts are not shuffled; with several,
without_leaks() drops texts by digest.

Defined cases: null, empty or wordless texts and passages match nothing. A passage found
in several places of a text gives one row, with its best match. Repeated documents give
repeated rows. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, tidy

BITS, STEP, RANK, OVERSAMPLE, POWER = 18, 16, 64, 8, 2
COVERAGE = 0.5
FIT_PASSAGES, BLOCK_ITEMS = 50_000, 20_000
#: Bytes of text coded at once, but for one longer text; words hashed at once.
_PIECE, _WORDS = 1 << 21, 1 << 16


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _plain(raw: bytes) -> bytes:
    word = raw.strip(_PUNCTUATION)
    if word.isascii():
        return word.lower()
    text = word.decode("utf-8", "replace").lower()
    lo, hi = 0, len(text)
    while lo < hi and not text[lo].isalnum():
        lo += 1
    while hi > lo and not text[hi - 1].isalnum():
        hi -= 1
    return text[lo:hi].encode("utf-8")


def _hashed(words: pa.Array) -> np.ndarray:
    """1 to 2 ** BITS - 1 by a polynomial hash of each plain word, or 0 for the empty one."""
    out = np.zeros(len(words), np.int32)
    for lo in range(0, len(words), _WORDS):
        part = pa.concat_arrays([words[lo : lo + _WORDS]]).cast(pa.large_binary())
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        sizes, ends = np.diff(ends), ends - ends[0]
        powers = np.multiply.accumulate(np.full(sizes.max(initial=1), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)  # differences of running sums are right modulo 2 ** 64
        np.cumsum((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)], out=sums[1:])
        h = sums[ends[1:]] - sums[ends[:-1]]
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(32)) % np.uint64((1 << BITS) - 1) + np.uint64(1)
        out[lo : lo + len(part)] = np.where(sizes > 0, h, 0)
    return out


def buckets(words: pa.Array) -> np.ndarray:
    """Bucket of each word as it stands: that of the word in lower case without outer
    punctuation, 0 for what has no letter or digit."""
    ascii_ = pc.string_is_ascii(words)
    plain = pc.ascii_lower(pc.ascii_trim(words.filter(ascii_), _PUNCTUATION.decode()))
    other = [_plain(w) for w in words.filter(pc.invert(ascii_)).cast(pa.binary()).to_pylist()]
    out, at = np.zeros(len(words), np.int32), ascii_.to_numpy(zero_copy_only=False)
    out[at] = _hashed(plain)
    out[~at] = _hashed(pa.array(other, pa.binary()))
    return out


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one text after the other, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    none = pc.index(words.dictionary, "").as_py()
    if none >= 0:  # before a first and after a last space
        text, code = text[code != none], code[code != none]
    return buckets(words.dictionary)[code], np.bincount(text, minlength=len(texts))


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about _PIECE bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PIECE, "right")))
        yield texts[lo:hi]
        lo = hi


def _raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with words, and for each bucket the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                codes, words = coded(piece)
                held = np.sort(np.repeat(np.arange(len(words)), words) << BITS | codes)
                held = held[np.r_[True, held[1:] != held[:-1]]] if len(held) else held
                df += np.bincount(held & (1 << BITS) - 1, minlength=1 << BITS)
                n += int((words > 0).sum())
        df[0] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])

    found = docs.select("text").mapInArrow(tidy(run), "bucket long, df long").groupBy("bucket").agg(F.sum("df")).collect()
    df = np.zeros(1 << BITS, np.int64)
    for b, n in found:
        df[b] = n
    return int(df[0]), df


def _tfidf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a passage and their weights, of length one."""
    b, _ = coded(pa.array([text], pa.string()))
    at, tf = np.unique(b[b > 0], return_counts=True)
    x = tf * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


def latent_words(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, right singular vectors over them) of the passages' TF-IDF rows.

    Subspace iteration: each round Spark sums a' (a G) over the distributed rows a, by
    bucket; the driver orthogonalises the sum, which has at most 2 ** BITS rows.
    """
    r = rank + OVERSAMPLE
    names = [f"z{k}" for k in range(r)]
    fit = passages.select("text").where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(FIT_PASSAGES)
    fit = fit.repartition(max(1, passages.sparkSession.sparkContext.defaultParallelism))
    at, basis = None, None
    for step in range(POWER + 1):
        shared = passages.sparkSession.sparkContext.broadcast((at, basis, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, basis, idf = shared.value
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    b, x = _tfidf(text, idf)
                    if not len(b):
                        continue
                    if basis is None:  # a row of the random start, from the hash of its bucket
                        g = np.stack([np.random.default_rng(int(i)).standard_normal(r) for i in b])
                    else:
                        g = basis[np.searchsorted(at, b)]
                    y = x @ g
                    for i, w in zip(b.tolist(), x):
                        sums[i] = sums.get(i, 0) + w * y
            keys = sorted(sums)
            z = np.stack([sums[k] for k in keys]) if keys else np.empty((0, r))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, z.T)], names=["bucket", *names])

        schema = "bucket long, " + ", ".join(f"{n} double" for n in names)
        summed = fit.mapInArrow(tidy(run), schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).orderBy("bucket").toPandas()
        if not len(summed):
            return np.empty(0, np.int64), np.empty((0, rank), np.float32)
        at, z = summed["bucket"].to_numpy(), summed[names].to_numpy()
        basis, spread = np.linalg.qr(z)
        if basis.shape[1] < r:
            basis = np.pad(basis, ((0, 0), (0, r - basis.shape[1])))
    u, _, _ = np.linalg.svd(spread)
    basis = basis[:, : u.shape[0]] @ u
    return at, basis[:, :rank].astype(np.float32)


def _lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[bytes, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _within(part: list[bytes], whole: list[bytes]) -> bool:
    k = len(part)
    return any(whole[i : i + k] == part for i in range(len(whole) - k + 1))


def _common(a: Counter, b: list[bytes]) -> int:
    """How many words of a, repeats included, b holds: no subsequence is longer."""
    return sum((a & Counter(w for w in b if w in a)).values())


def _extra_vectors(buckets: np.ndarray, like: np.ndarray, rank: int) -> np.ndarray:
    """Random vectors of words outside the fitted ones, of the root mean square length."""
    size = np.sqrt((like.astype(np.float64) ** 2).sum(axis=1).mean()) if len(like) else 1.0
    rows = [np.random.default_rng(int(b)).standard_normal(rank) for b in buckets]
    x = np.stack(rows) if rows else np.zeros((0, rank))
    return (x * (size or 1.0) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Matcher:
    """Finds the passages of one block in batches of texts; sent to the tasks."""

    def __init__(self, items, at, vectors, idf, cosine, lcs, lcs_with_answer):
        self.cosine, self.lcs, self.with_answer = cosine, lcs, lcs_with_answer
        rank = vectors.shape[1]
        split = [[w for w in map(_plain, _raw_words(text)) if w] for _, text, _ in items]
        codes = [_hashed(pa.array(words, pa.binary())) for words in split]
        extra = np.setdiff1d(np.unique(np.concatenate([np.empty(0, np.int64), *codes])), at).astype(np.int64)
        at, vectors = np.r_[at, extra], np.vstack([vectors, _extra_vectors(extra, vectors, rank)])
        self.row = np.zeros(1 << BITS, np.int32)
        self.row[at] = np.arange(1, len(at) + 1)
        self.vectors = np.vstack([np.zeros((1, rank), np.float32), vectors * idf[at, None].astype(np.float32)])
        self.ids, self.words, self.answers, rows = [], [], [], []
        for (item, _, answer), words, code in zip(items, split, codes):
            if not words:
                continue
            self.ids.append(item)
            self.words.append(words)
            self.answers.append([w for w in map(_plain, _raw_words(answer)) if w] or words[-max(3, len(words) // 5) :])
            rows.append(self.vectors[self.row[code]].sum(axis=0))
        m = np.stack(rows) if rows else np.zeros((0, rank), np.float32)
        length = np.linalg.norm(m, axis=1)
        self.matrix = np.ascontiguousarray((m / np.maximum(length[:, None], 1e-9)).T)
        # A window holds at least part of a passage's own weight: of a long one, that of
        # the words that one window can hold.
        sizes = np.array([len(w) for w in self.words])
        self.least = (COVERAGE * length * np.minimum(1, 1.5 * STEP / np.maximum(sizes, 1))).astype(np.float32)
        self.bags = [Counter(w) for w in self.words]

    def find(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text its (item, cosine, share of the subsequence, answer found)."""
        if not self.ids:
            return [[] for _ in range(len(texts))]
        return [found for piece in _pieces(texts) for found in self._some(piece)]

    def _some(self, texts: pa.Array) -> list[list[tuple]]:
        codes, words = coded(texts)
        blocks = -(-words // STEP) + 1  # one more, empty, ends each text
        starts = np.cumsum(blocks) - blocks
        flat = np.zeros(int(blocks.sum()) * STEP, np.int32)
        flat[np.arange(len(codes)) + np.repeat(starts * STEP - np.cumsum(words) + words, words)] = codes
        rows = self.row[flat]
        sums = np.empty((len(flat) // STEP, self.vectors.shape[1]), np.float32)
        for b in range(0, len(sums), 1024):
            part = rows[b * STEP : (b + 1024) * STEP]
            sums[b : b + 1024] = self.vectors[part].reshape(-1, STEP, sums.shape[1]).sum(axis=1)
        windows = sums[:-1] + sums[1:]
        norms = np.linalg.norm(windows, axis=1)
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        best: dict[tuple[int, int], list] = {}
        for b in range(0, len(windows), 4096):
            like = windows[b : b + 4096] @ self.matrix
            w, item = np.nonzero((like >= self.least) & (like >= self.cosine * np.maximum(norms[b : b + 4096, None], 1e-6)))
            for x, i in zip(w.tolist(), item.tolist()):
                doc = int(np.searchsorted(starts, b + x, "right")) - 1
                best.setdefault((doc, i), []).append((b + x - int(starts[doc]), float(like[x, i] / norms[b + x])))
        raw = {doc: _raw_words(texts[doc].as_py()) for doc in {d for d, _ in best}}
        for (doc, i), at in best.items():
            found = None
            for window, cos in at:
                share, answer = self.checked(raw[doc], i, window)
                if share >= self.lcs or (share >= self.with_answer and answer):
                    found = max(found or (-1.0,), (share, cos, answer))
            if found:
                out[doc].append((self.ids[i], found[1], found[0], found[2]))
        return out

    def checked(self, raw: list[bytes], i: int, window: int) -> tuple[float, bool]:
        """The share of passage i that is a subsequence of the words around a window, and
        whether its answer stands there."""
        words = self.words[i]
        segment = raw[max(0, window * STEP - len(words)) : (window + 2) * STEP + len(words)]
        segment = [w for w in map(_plain, segment) if w]
        if _common(self.bags[i], segment) < self.with_answer * len(words):
            return 0.0, False  # too few words in common for the subsequence
        return _lcs(words, segment) / len(words), _within(self.answers[i], segment)


def _matchers(docs: DataFrame, benchmark: DataFrame, cosine: float, lcs: float, lcs_with_answer: float) -> tuple[int, Iterator]:
    """The number of blocks of passages, and one broadcast Matcher for each in turn."""
    spark = docs.sparkSession
    small_batches(spark)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    n_docs, df = document_frequencies(docs)
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    at, vectors = latent_words(items, idf)
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))

    def each() -> Iterator:
        for k in range(blocks):
            part = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k)
            rows = [tuple(r) for r in part.orderBy("item_id", "text").collect()]
            yield spark.sparkContext.broadcast(Matcher(rows, at, vectors, idf, cosine, lcs, lcs_with_answer))

    return blocks, each()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, lcs: float = 0.75, lcs_with_answer: float = 0.6
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found) for every passage found."""
    found = None
    blocks, matchers = _matchers(docs, benchmark, cosine, lcs, lcs_with_answer)
    for shared in matchers:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(d, *m) for d, ms in zip(ids, shared.value.find(batch.column(1))) for m in ms]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                    names=["doc_id", "item_id", "cosine", "lcs_share", "answer_found"],
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            tidy(run), "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"
        )
        if blocks > 1:
            part = stage(part)
            shared.destroy()
        found = part if found is None else found.union(part)
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, lcs: float = 0.75, lcs_with_answer: float = 0.6
) -> DataFrame:
    """The rows of docs in which find_leaks() finds no passage, with all columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col("text").alias("text"))
    blocks, matchers = _matchers(docs, benchmark, cosine, lcs, lcs_with_answer)
    leaks = None
    for shared in matchers:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not m for m in shared.value.find(batch.column(batch.schema.get_field_index("text")))]
                yield batch.filter(pa.array([c == (blocks == 1) for c in clean], pa.bool_()))

        if blocks == 1:
            return rows.mapInArrow(tidy(run), T.StructType(rows.schema.fields)).select("doc.*")
        part = stage(docs.select("text").mapInArrow(tidy(run), "text string").select(F.md5("text").alias("digest")).distinct())
        shared.destroy()
        leaks = part if leaks is None else leaks.union(part)
    rows = rows.withColumn("digest", F.md5("text"))
    return rows.join(leaks.distinct(), "digest", "left_anti").select("doc.*")
