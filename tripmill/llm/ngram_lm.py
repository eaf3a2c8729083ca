"""Deleted-interpolation bigram model scored over a whole corpus.

P(w | v) = a[b] * c(v, w) / c(v) + b[b] * c(w) / N + c[b] / (V + 1), with weights by the
bucket b of the context's frequency. Counts come from the training documents. The
weights are fitted by expectation-maximisation on held-out counts: one training fold is
deleted from the counts, and its bigrams are predicted from the rest.

A task numbers the distinct words and bigrams of a block of documents and sends each
distinct one once, as a 64-bit hash with the block's counts, to the shard of its hash;
shards add the counts up and answer. Answers meet the block's positions again, which
are then staged, so that scores need no second shuffle. Frequent n-grams are sent once
from a block, so no key is hot. A task holds one block, or the distinct n-grams of one
shard; shards are four times spark.sql.shuffle.partitions, which is to grow with the
corpus. docs must be a plan that repeats its partitions (a table scan): both passes
digest each block's ids and tokens in order, and a difference stops the job.

Two of n distinct n-grams share a hash with probability below n^2 / 2^65.

Defined cases: a null or blank text is the end token alone. Repeated rows count and are
scored row by row; a null doc_id is hashed as the empty text. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNLIKE, _Codes, _pack, _unpack
from .common import fold, partitions, small_batches, stage, tidy

BLOCK_TOKENS = 3_000_000
HELD_OUT, DELETED = 1, 0  # remainders of crc32 modulo 5
END, BOS = 0, 1  # codes of every block
_SPECIAL = {END: b"\n", BOS: b"\n\n"}  # never words
BUCKETS, _Q2, _Q1 = 16, 48, 64


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, digest, codes, ids, roles, tokens of each text with its end, flat codes); the
    digest is that of all ids and tokens in order."""
    block, held = TaskContext.get().partitionId() << 24, 0

    def fresh():
        codes = _Codes()
        for word in _SPECIAL.values():
            codes[word]
        return codes, [], [], [], []

    def done() -> tuple:
        flat = np.concatenate(arrays)
        digest = xxhash.xxh3_64(flat.tobytes())
        digest.update(np.array(sizes).tobytes() + repr(ids).encode())
        digest.update(b" ".join(codes))
        return block, digest.intdigest() >> 1, codes, ids, roles, sizes, flat

    codes, ids, roles, sizes, arrays = fresh()
    for batch in batches:
        for doc, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = _words_of(text)
            a = np.zeros(len(words) + 1, np.uint32)
            a[:-1] = np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))
            ids.append(doc)
            roles.append(role)
            sizes.append(len(a))
            arrays.append(a)
            held += len(a)
            if held >= BLOCK_TOKENS:
                yield done()
                block, held = block + 1, 0
                codes, ids, roles, sizes, arrays = fresh()
    if ids:
        yield done()


def _pairs(flat: np.ndarray, sizes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the distinct bigrams, their words, and each token's bigram."""
    key = np.empty(len(flat), np.int64)
    key[1:] = flat[:-1]
    key[np.cumsum(sizes) - sizes] = BOS
    key *= n_codes
    key += flat
    pair, inverse = np.unique(key, return_inverse=True)
    return pair // n_codes, pair % n_codes, inverse


def _shard_of_pair(low: np.ndarray, context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return (low[context].astype(np.uint32) * 40503 + low[word]) % 65521 % shards


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)
        x ^= (x >> np.uint64(29)) ^ b
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0x94D049BB133111EB) ^ b


def _hashes(codes: _Codes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))


def _counts_by_role(at: np.ndarray, roles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    rest = np.bincount(at[(roles != HELD_OUT) & (roles != DELETED)], minlength=n)
    return rest, np.bincount(at[roles == DELETED], minlength=n)


def _requests(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digest, codes, _, roles, sizes, flat in _blocks(batches):
            h, sizes, roles = _hashes(codes), np.array(sizes), np.array(roles)
            low, role = (h & np.uint64(0xFFFF)).astype(np.uint32), np.repeat(roles, sizes)
            rest, deleted = _counts_by_role(flat, role, len(h))
            rest[BOS], deleted[BOS] = ((roles != HELD_OUT) & (roles != DELETED)).sum(), (roles == DELETED).sum()
            context, word, inverse = _pairs(flat, sizes, len(h))
            sent = [(0, h, rest, deleted, low % shards)]
            sent.append((1, _mix(h[context], h[word]), *_counts_by_role(inverse, role, len(context)), _shard_of_pair(low, context, word, shards)))
            for kind, key, rest, deleted, shard in sent:
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([2 * s + kind for s, _ in rows], pa.int32()),
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([digest] * len(rows), pa.int64()),
                        pa.array([key[o].tobytes() for _, o in rows], pa.binary()),
                        pa.array([_pack(rest[o]) for _, o in rows], pa.binary()),
                        pa.array([_pack(deleted[o]) for _, o in rows], pa.binary()),
                    ],
                    names=["shard", "block", "digest", "keys", "rest", "deleted"],
                )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of a shard's keys and answer each block; rows come sorted by
    shard. The first answer of a shard of words says how many it knows."""
    special = np.array([xxhash.xxh64_intdigest(_SPECIAL[BOS])], np.uint64)
    held: list[dict] = []

    def out() -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], np.uint64) for r in held]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        rest, deleted = (
            np.bincount(inverse, np.concatenate([_unpack(r[c]) for r in held]), len(distinct)).astype(np.int64)
            for c in ("rest", "deleted")
        )
        known = int(((rest + deleted > 0) & (distinct != special)).sum()) if held[0]["shard"] % 2 == 0 else 0
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        parts = np.split(inverse, cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["block"] for r in held], pa.int64()),
                pa.array([r["digest"] for r in held], pa.int64()),
                pa.array([r["shard"] for r in held], pa.int32()),
                pa.array([_pack(rest[p]) for p in parts], pa.binary()),
                pa.array([_pack(deleted[p]) for p in parts], pa.binary()),
                pa.array([known] + [0] * (len(held) - 1), pa.int64()),
            ],
            names=["block", "digest", "shard", "rest", "deleted", "known"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield out()
                held = []
            held.append(row)
    if held:
        yield out()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, digest, codes, ids, roles, sizes, flat in _blocks(batches):
        low = (_hashes(codes) & np.uint64(0xFFFF)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([digest], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([roles], pa.list_(pa.int64())),
                pa.array([_pack(np.array(sizes))], pa.binary()),
                pa.array([_pack(flat)], pa.binary()),
                pa.array([low.tobytes()], pa.binary()),
            ],
            names=["block", "digest", "ids", "roles", "sizes", "codes", "low"],
        )


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _cells(context: np.ndarray, word: np.ndarray, pair: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Held-out bigrams binned by (bucket, log of c(v, w) / c(v), log of c(w)): cell, sum
    of n, of n * c(v, w) / c(v), of n * c(w). All arrays are counts without the deleted
    fold, by distinct bigram; n counts the deleted fold's bigrams."""
    use = n > 0
    context, word, pair, n = context[use], word[use], pair[use], n[use]
    p2 = pair / np.maximum(context, 1)
    q2 = np.where(p2 > 0, np.clip((-np.log2(np.maximum(p2, 1e-12)) * 2).astype(np.int64) + 1, 1, _Q2 - 1), 0)
    q1 = np.where(word > 0, np.clip((np.log2(np.maximum(word, 1)) * 2).astype(np.int64) + 1, 1, _Q1 - 1), 0)
    cell, at = np.unique((_bucket(context) * _Q2 + q2) * _Q1 + q1, return_inverse=True)
    sums = [np.bincount(at, n * x, len(cell)) for x in (1.0, p2, word.astype(float))]
    return list(zip(cell.tolist(), *(s.tolist() for s in sums)))


def _meet(shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {r["shard"]: r for r in right.to_pylist()}
        if len(set(left["digest"].to_pylist()) | {r["digest"] for r in answers.values()}) > 1 or len(left) != 1:
            raise RuntimeError(UNLIKE)
        out = []
        for row in left.to_pylist():
            low = np.frombuffer(row["low"], np.uint16)
            sizes, flat = _unpack(row["sizes"]).astype(np.int64), _unpack(row["codes"])
            context, word, inverse = _pairs(flat, sizes, len(low))
            shard = _shard_of_pair(low, context, word, shards)
            by_kind = []
            for kind, s_of in ((0, low.astype(np.uint32) % shards), (1, shard)):
                rest, deleted = np.zeros(len(s_of), np.int64), np.zeros(len(s_of), np.int64)
                order = np.argsort(s_of, kind="stable")
                cuts = np.searchsorted(s_of[order], np.arange(shards + 1))
                for s in range(shards):
                    if cuts[s + 1] > cuts[s]:
                        o, r = order[cuts[s] : cuts[s + 1]], answers[2 * s + kind]
                        rest[o], deleted[o] = _unpack(r["rest"]), _unpack(r["deleted"])
                by_kind.append((rest, deleted))
            (u_rest, u_deleted), (p_rest, p_deleted) = by_kind
            role = np.repeat(np.array(row["roles"]), sizes)
            n = np.bincount(inverse[role == DELETED], minlength=len(context))
            cells = _cells(u_rest[context], u_rest[word], p_rest, n)
            out.append(
                (
                    row["ids"], row["roles"], row["sizes"], row["codes"], _pack(u_rest + u_deleted), _pack(p_rest + p_deleted),
                    [dict(zip(("cell", "n", "s2", "s1"), c)) for c in cells], int((role != HELD_OUT).sum()),
                    int(((role != HELD_OUT) & (role != DELETED)).sum()), sum(r["known"] for r in answers.values()),
                )
            )
        cell = pa.list_(pa.struct([("cell", pa.int64()), ("n", pa.float64()), ("s2", pa.float64()), ("s1", pa.float64())]))
        long = pa.list_(pa.int64())
        types = [long, long, *[pa.binary()] * 4, cell, *[pa.int64()] * 3]
        names = ["ids", "roles", "sizes", "codes", "words", "pairs", "cells", "train", "kept", "known"]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)

    return run


def fit_weights(cells: list[tuple[int, float, float, float]], n_rest: int, v: int, rounds: int = 80) -> np.ndarray:
    """Mixture weights [bucket, (bigram, unigram, uniform)] from binned held-out counts.

    A bucket without counts takes the weights of the next lower one; the unseen context
    has no bigram part.
    """
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = (0, 0.9, 0.1)
    cells = sorted(cells)
    bucket = np.array([c[0] // (_Q2 * _Q1) for c in cells], np.int64)
    n = np.array([c[1] for c in cells])
    for b in range(BUCKETS):
        here = np.flatnonzero(bucket == b)
        if not len(here):
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        p = np.stack(
            [
                np.array([cells[i][2] for i in here]) / n[here],
                np.array([cells[i][3] for i in here]) / n[here] / max(n_rest, 1),
                np.full(len(here), 1 / (v + 1)),
            ]
        )
        w = weights[b].copy()
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * n[here]).sum(axis=1) + (np.array([0.01, 0.01, 0.01]) if b else np.array([0, 0.01, 0.01]))
            w /= w.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigram)
    and score (the model) of every whole text, both log10."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long"), fold(F.col("doc_id"), 5).cast("long"), "text")
    n = partitions(spark)
    shards = min(4 * n, 65521)
    answers = (
        source.mapInArrow(tidy(_requests(shards)), "shard int, block long, digest long, keys binary, rest binary, deleted binary")
        .repartition(n, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(tidy(_answers), "block long, digest long, shard int, rest binary, deleted binary, known long")
    )
    places = source.mapInArrow(
        tidy(_positions), "block long, digest long, ids array<long>, roles array<long>, sizes binary, codes binary, low binary"
    )
    met = stage(
        places.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            _meet(shards),
            "ids array<long>, roles array<long>, sizes binary, codes binary, words binary, pairs binary, "
            "cells array<struct<cell: long, n: double, s2: double, s1: double>>, train long, kept long, known long",
        )
    )
    total, kept, v = met.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("train", "kept", "known")]).first()
    cells = met.select(F.inline("cells")).groupBy("cell").agg(*[F.sum(c) for c in ("n", "s2", "s1")]).collect()
    weights = fit_weights([tuple(r) for r in cells], kept, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, flat = _unpack(row["sizes"]).astype(np.int64), _unpack(row["codes"])
                c1, c2 = _unpack(row["words"]).astype(float), _unpack(row["pairs"]).astype(float)
                context, word, inverse = _pairs(flat, sizes, len(c1))
                w = weights[_bucket(c1[context])]
                p = w[:, 0] * c2 / np.maximum(c1[context], 1) + w[:, 1] * c1[word] / max(total, 1) + w[:, 2] / (v + 1)
                starts = np.cumsum(sizes) - sizes
                base = np.log10((c1 + 0.5) / (total + 0.5 * (v + 1)))
                sums = [np.add.reduceat(x, starts) for x in (c1[flat] > 0, base[flat], np.log10(p)[inverse])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array([r == HELD_OUT for r in row["roles"]], pa.bool_()),
                        pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array([total] * len(sizes), pa.int64()),
                        pa.array(sums[1]), pa.array(sums[2]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return met.select("ids", "roles", "sizes", "codes", "words", "pairs").mapInArrow(
        tidy(run),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
