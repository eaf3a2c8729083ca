"""Byte-level BPE encoding and decoding of a corpus by a global distinct-word shuffle.

1. Each task cuts its texts into words at single spaces between other characters, which
   is always a boundary of pre-tokens, and numbers the distinct words of its block.
2. The blocks' distinct words are dealt by the hash of the word, so that each meets its
   repeats and is encoded once: every match of the pattern by itself, by the ranks.
3. The ids go back to their blocks and are put together by position.
4. Decoding looks ids up in the token-byte table (bounded by the vocabulary) and joins
   the bytes in order.

Blocks hold a bounded number of words, and hot words come once from each block, so no
key grows with the corpus. A task that encodes holds the distinct words of one shard at a
time; shards are four times spark.sql.shuffle.partitions, which is to be set by the size
of the vocabulary. The words and the positions of a block are two passes over the same
scan; docs must therefore be a plan that repeats its partitions (a table scan). Both
passes digest each block's ids and words in order, and a difference stops the job.

Defined cases: a null or empty text has no ids. Repeated rows are encoded row by row.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, release, small_batches, tidy

BLOCK_WORDS = 4_000_000
UNLIKE = "two passes over docs differ; docs must be a repeatable scan, such as a table"
_ODD = re.compile(r"^ | $| \s|\s ")
_GAP = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[tuple[str, str], object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path, pattern]


class _Codes(dict):
    """Numbers words as they first come. A word that follows a space is kept without it;
    the first word of a text is kept behind an added space."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _split(text: str | None) -> list[str]:
    if not text:
        return []
    words = _GAP.split(text) if _ODD.search(text) else text.split(" ")
    words[0] = " " + words[0]
    return words


def _blocks(batches: Iterator[pa.RecordBatch], hold: bool = True) -> Iterator[tuple[int, int, _Codes, list, list[int], list[np.ndarray]]]:
    """(block, digest, codes, doc ids, words of each, their codes) of at most BLOCK_WORDS
    words and one text more. The digest is that of all ids and words in order."""
    block, held = TaskContext.get().partitionId() << 24, 0
    codes, ids, sizes, arrays, digest = _Codes(), [], [], [], xxhash.xxh3_64()

    def done() -> tuple:
        names = list(codes)
        digest.update(np.fromiter(map(len, names), np.int64, len(names)).tobytes() + repr(ids).encode())
        digest.update("".join(names).encode("utf-8", "surrogatepass"))
        return block, digest.intdigest() >> 1, codes, ids, sizes, arrays

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _split(text)
            array = np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))
            digest.update(len(words).to_bytes(8, "little") + array.tobytes())
            if hold:
                sizes.append(len(words))
                arrays.append(array)
            ids.append(doc)
            held += len(words)
            if held >= BLOCK_WORDS:
                yield done()
                block, held = block + 1, 0
                codes, ids, sizes, arrays, digest = _Codes(), [], [], [], xxhash.xxh3_64()
    if ids:
        yield done()


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of little-endian unsigned numbers, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digest, codes, *_ in _blocks(batches, hold=False):
            deal: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(shards)]
            for word, code in codes.items():
                raw = word[1:].encode() if word[0] == " " else b" " + word.encode()
                to = deal[zlib.crc32(raw) % shards]
                to[0].append(code)
                to[1].append(raw)
            rows = [(s, c, w) for s, (c, w) in enumerate(deal) if c]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _, _ in rows], pa.int32()),
                    pa.array([block] * len(rows), pa.int64()),
                    pa.array([digest] * len(rows), pa.int64()),
                    pa.array([_pack(np.diff(np.array(c), prepend=0)) for _, c, _ in rows], pa.binary()),
                    pa.array([_pack(np.array([len(x) for x in w])) for _, _, w in rows], pa.binary()),
                    pa.array([b"".join(w) for _, _, w in rows], pa.binary()),
                ],
                names=["shard", "block", "digest", "codes", "sizes", "words"],
            )

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, digest, codes, ids, sizes, arrays in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([digest], pa.int64()),
                pa.array([len(codes)], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([_pack(np.array(sizes))], pa.binary()),
                pa.array([_pack(np.concatenate(arrays))], pa.binary()),
            ],
            names=["block", "digest", "n_words", "ids", "sizes", "codes"],
        )


def _encode_shards(path: str, pattern: str):
    """Encode each distinct word of a shard once; rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        known: dict[bytes, np.ndarray] = {}
        shard = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, known = row["shard"], {}
                ends = np.cumsum(_unpack(row["sizes"])).tolist()
                words, lo, found = row["words"], 0, []
                for hi in ends:
                    word = words[lo:hi]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), "<u4")
                    found.append(ids)
                    lo = hi
                out.append((row["block"], row["digest"], row["codes"], _pack(np.array([len(x) for x in found])), _pack(np.concatenate(found))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], pa.int64() if k < 2 else pa.binary()) for k in range(5)],
                names=["block", "digest", "codes", "counts", "ids"],
            )

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of every text of a block, as little-endian unsigned 32-bit numbers."""
    docs, out = [], []
    parts = pool = count = start = codes = None
    if len(set(left["digest"].to_pylist()) | set(right["digest"].to_pylist())) > 1 or (len(right) and not len(left)):
        raise RuntimeError(UNLIKE)
    for row in left.to_pylist():
        count = np.zeros(row["n_words"], np.int64)
        start = np.zeros(row["n_words"], np.int64)
        parts, at = [], 0
        for r in right.to_pylist():
            codes, n, ids = np.cumsum(_unpack(r["codes"])), _unpack(r["counts"]).astype(np.int64), _unpack(r["ids"])
            count[codes] = n
            start[codes] = at + np.cumsum(n) - n
            parts.append(ids)
            at += len(ids)
        if (count == 0).any():
            raise RuntimeError(UNLIKE)
        pool = np.concatenate(parts) if parts else np.empty(0, "<u4")
        sizes, codes = _unpack(row["sizes"]).astype(np.int64), _unpack(row["codes"])
        word_ends = np.r_[0, np.cumsum(sizes)]
        lo = 0
        while lo < len(sizes):  # about a quarter of a million words at a time
            hi = max(lo + 1, int(np.searchsorted(word_ends, word_ends[lo] + 250_000, "right")) - 1)
            c = codes[word_ends[lo] : word_ends[hi]]
            n = count[c]
            ends = np.r_[0, np.cumsum(n)]
            ids = pool[np.repeat(start[c] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[word_ends[lo : hi + 1] - word_ends[lo]].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            lo = hi
        docs += row["ids"]
    done = pa.table([pa.array(docs, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "ids"])
    del parts, pool, out, count, start, codes
    release()
    return done


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as binary, little-endian unsigned 32-bit, of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    n = partitions(spark)
    words = (
        source.mapInArrow(tidy(_words(4 * n)), "shard int, block long, digest long, codes binary, sizes binary, words binary")
        .repartition(n, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(tidy(_encode_shards(path, pattern)), "block long, digest long, codes binary, counts binary, ids binary")
    )
    blocks = source.mapInArrow(tidy(_positions), "block long, digest long, n_words long, ids array<long>, sizes binary, codes binary")
    return (
        blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids binary")
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) plus decoded, the bytes of the ids; the token-byte table is
    broadcast, its size being that of the vocabulary."""
    ranks = read_ranks(path)
    if len(ranks) > 2_000_000:
        raise ValueError("the vocabulary is too large to broadcast")
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(get, np.frombuffer(b, "<u4").tolist())) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids binary, decoded binary")
