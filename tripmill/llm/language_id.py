"""Language identification by a byte convolutional network.

Filters of several widths slide over windows of WINDOW bytes of the lower-cased text;
each filter's largest activation in the window goes to a softmax over the languages. The
network is trained in numpy on one window of each of at most FIT_ROWS labelled documents
(in order of the hash of their id, the window's place drawn from that hash). Every byte
of every text is in a window; a text's log probabilities are the mean over its windows.

Defined cases: a null text, or one without a letter, is `und` with score 0. Repeated rows
are predicted row by row. Without labelled documents every text is `und`. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, tidy

WINDOW, FILTERS, WIDTHS = 256, 12, (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
FIT_ROWS, EPOCHS, BATCH, MAX_LANGS = 4_000, 8, 64, 400
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """One-hot byte convolutions as table look-ups: tables[w][j][byte] are the weights of
    filter group w at offset j."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [(rng.standard_normal((w, 256, FILTERS)) * 0.5).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = (rng.standard_normal((len(WIDTHS) * FILTERS, len(langs))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self._pairs = None

    def _convolve(self, x: np.ndarray, g: int) -> np.ndarray:
        n = x.shape[1] - max(WIDTHS) + 1
        t = self.tables[g]
        return sum(t[j][x[:, j : j + n]] for j in range(1, len(t))) + t[0][x[:, :n]] + self.bias[g]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam on the cross-entropy; x: windows of bytes, y: places in langs."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                b = order[lo : lo + BATCH]
                xb, rows = x[b], np.arange(len(b))
                pooled, where = [], []
                for g in range(len(WIDTHS)):
                    z = self._convolve(xb, g)
                    at = z.argmax(axis=1)
                    pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
                    where.append(at)
                z = np.concatenate(pooled, axis=1)
                h = np.maximum(z, 0)
                logits = h @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[rows, y[b]] -= 1
                p /= len(b)
                dz = (p @ self.out.T) * (z > 0)
                grads = [np.zeros_like(t) for t in params]
                for g, w in enumerate(WIDTHS):
                    d = dz[:, g * FILTERS : (g + 1) * FILTERS]
                    grads[len(WIDTHS)][g] = d.sum(axis=0)
                    for j in range(w):
                        byte = np.take_along_axis(xb, where[g] + j, 1)
                        np.add.at(grads[g][j], (byte, np.arange(FILTERS)[None, :]), d)
                grads[-2], grads[-1] = h.T @ p, p.sum(axis=0)
                step += 1
                for k, grad in enumerate(grads):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    params[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window; adjacent bytes are looked up in pairs."""
        if self._pairs is None:
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
            t2, t3, t4 = self.tables
            self._pairs = [pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3])]
        n = x.shape[1] - max(WIDTHS) + 1
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        now, later = two[:, :n], two[:, 2 : n + 2]
        p2, p3, p4, p4b = self._pairs
        pooled = [p2[now].max(axis=1), (p3[now] + self.tables[1][2][x[:, 2 : n + 2]]).max(axis=1), (p4[now] + p4b[later]).max(axis=1)]
        h = np.maximum(np.concatenate([a + b for a, b in zip(pooled, self.bias)], axis=1), 0)
        logits = h @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            x = np.concatenate([w for _, w in held])
            logs = np.concatenate([self.log_probabilities(x[k : k + 256]) for k in range(0, len(x), 256)])
            ends = np.cumsum([len(w) for _, w in held])
            for (k, w), end in zip(held, ends):
                mean = logs[end - len(w) : end].mean(axis=0)
                p = np.exp(mean - mean.max())
                best = int(p.argmax())
                out[k] = (self.langs[best], float(p[best] / p.sum()))
            held.clear()

        for k, text in enumerate(texts):
            if self.langs and text and _LETTER.search(text):
                held.append((k, windows(text, STRIDE)))
                if sum(len(w) for _, w in held[-64:]) >= 2048 or len(held) >= 64:
                    flush()
        if held:
            flush()
        return out


def windows(text: str, stride: int) -> np.ndarray:
    """Windows that cover all bytes of the lower-cased text; the last is padded with
    spaces."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(raw) - max(WIDTHS) + 1) // stride))
    padded = np.full((n - 1) * stride + WINDOW, 32, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::stride]


def training_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, one window of each sampled document, and its language's place."""
    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
    counts = known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    langs, n = sorted(r["lang"] for r in counts), sum(r["count"] for r in counts)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    draw = F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    picked = known.select("doc_id", "lang", F.substring("text", draw.cast("int") + 1, F.lit(WINDOW)).alias("part")).where(F.col("part").rlike(r"\p{L}"))
    # About twice the rows that are needed are left before the sort, however large docs is.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(10**9))
    picked = picked.where(place < int(2e9 * FIT_ROWS / max(n, 1)))
    rows = picked.orderBy(place, "doc_id", "part").limit(FIT_ROWS).select("lang", "part").collect()
    x = np.stack([windows(r["part"], STRIDE)[0] for r in rows]) if rows else np.empty((0, WINDOW), np.uint8)
    return langs, x, np.array([langs.index(r["lang"]) for r in rows], np.int64)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    langs, x, y = training_windows(docs)
    network = Network(langs if len(x) else [])
    if len(x):
        network.train(x, y)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text").mapInArrow(
        tidy(run), "doc_id long, held_out boolean, lang_pred string, score double"
    )
