"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-
maximisation over the counts of vote patterns estimates how often each rule votes and
is right in either class; the posterior probability of the good class decides, so that
no single rule rejects a document.

Defined cases: a null or blank text has no words, every count 0, and is not kept; only
the base floor and the posterior decide, whatever the other columns hold. Repeated rows
are judged row by row. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, tidy

SYMBOLS = "#*$%&|<>"
_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: n_short: words of up to three bytes with a letter or digit; n_bare: those without.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_short", "n_bare", "n_lines")

#: rule name -> (feature, good below, bad above); between the two the rule abstains.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("symbol_rate", 0.05, 0.2),
    "repeats": ("repeat_rate", 0.2, 0.35),
    "dup_lines": ("dup_line_rate", 0.3, 0.6),
    "shouting": ("upper_rate", 0.15, 0.35),
    "short_words": ("long_word_rate", 6.5, 9.0),
    "few_short": ("no_short_rate", 0.85, 0.97),
    "bare_words": ("bare_rate", 0.03, 0.15),
    "length": ("brevity", 0.0125, 0.02),
}


def _counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    n = len(words)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeat = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        v = len(ids)
        _, pair = np.unique(code[:-1] * v + code[1:], return_inverse=True)
        _, inverse, count = np.unique(pair[:-1] * v + code[2:], return_inverse=True, return_counts=True)
        found = np.flatnonzero(count[inverse] > 1)
        if len(found):
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[found + k] = True
            repeat = int(covered.sum())
    arr = np.frombuffer(raw, np.uint8)
    upper = int(((arr >= 65) & (arr <= 90)).sum())
    lower = int(((arr >= 97) & (arr <= 122)).sum())
    bare = sum(1 for w in words if len(w) <= 3 and w.isascii() and not w.isalnum() and not any(c in _ALNUM for c in w))
    short = sum(1 for w in words if len(w) <= 3) - bare
    return (n, len(text) - spaces, n_symbols, len(lines) - len(set(lines)), repeat, upper, upper + lower, short, bare, len(lines))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_counts(t) for t in batch.column(1).to_pylist()]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[batch.schema.names[0], *COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """The first column of docs as it is and the counts of its second, the whole text;
    one narrow pass."""
    small_batches(docs.sparkSession)
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(tidy(_batches), T.StructType([docs.schema[0], *counts]))


def votes(counts: DataFrame) -> DataFrame:
    """counts plus one column vote_<rule> of -1, 0 or 1."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    features = {
        "symbol_rate": F.col("n_symbols") / n,
        "repeat_rate": F.col("n_repeat_words") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_rate": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "long_word_rate": F.col("word_chars") / n,
        "no_short_rate": 1 - F.col("n_short") / n,
        "bare_rate": F.col("n_bare") / n,
        "brevity": 1 / n,
    }
    out = {}
    for rule, (feature, good, bad) in RULES.items():
        x = features[feature]
        vote = F.when(x > bad, -1).when(x < good, 1).otherwise(0)
        out[f"vote_{rule}"] = F.when(F.col("n_words") == 0, 0).otherwise(vote).cast("int")
    return counts.withColumns(out)


def fit_em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.8) -> tuple[float, np.ndarray]:
    """(share of good documents, table [class, rule, vote + 1] of vote probabilities).

    patterns: distinct vote patterns with their counts, 3 ** rules at most. The start
    trusts each rule at 0.8; Laplace smoothing keeps every probability positive.
    """
    rules = len(RULES)
    table = np.empty((2, rules, 3))
    table[1] = (0.1, 0.2, 0.7)
    table[0] = (0.4, 0.3, 0.3)
    if not patterns:
        return prior, table
    patterns = sorted(patterns)
    v = np.array([p for p, _ in patterns]) + 1
    w = np.array([c for _, c in patterns], float)
    for _ in range(rounds):
        post = posterior(prior, table, v)
        prior = float(np.clip((w * post).sum() / w.sum(), 0.05, 0.98))
        for c, weight in ((1, w * post), (0, w * (1 - post))):
            for r in range(rules):
                for k in range(3):
                    table[c, r, k] = (weight[v[:, r] == k].sum() + 1) / (weight.sum() + 3)
    # A rule's good vote must not count against a document, nor a bad vote for it.
    for r in range(rules):
        if table[1, r, 2] < table[0, r, 2] and table[1, r, 0] > table[0, r, 0]:
            table[:, r] = table[:, r].mean(axis=0)
    return prior, table


def posterior(prior: float, table: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Probability of the good class of each row of v (votes plus 1)."""
    at = np.arange(v.shape[1])
    log = [np.log(table[c][at, v]).sum(axis=1) for c in (0, 1)]
    odds = math.log(prior / (1 - prior)) + log[1] - log[0]
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(voted: DataFrame) -> DataFrame:
    """Posterior p_good of each vote pattern in voted; at most 3 ** rules rows."""
    names = [f"vote_{r}" for r in RULES]
    found = voted.where("n_words > 0").groupBy(*names).count().collect()
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in found]
    prior, table = fit_em(patterns)
    known = sorted({p for p, _ in patterns} | {(0,) * len(names)})
    p_good = posterior(prior, table, np.array(known) + 1)
    return voted.sparkSession.createDataFrame(
        [(*p, float(g)) for p, g in zip(known, p_good)], ", ".join(f"{n} int" for n in names) + ", p_good double"
    )


def _decide(voted: DataFrame, posteriors: DataFrame, keep_at: float, min_words: int, max_repeat_pct: int) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return (
        voted.join(F.broadcast(posteriors), [f"vote_{r}" for r in RULES])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))
    )


def judge(docs: DataFrame, keep_at: float = 0.5, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """One row per document: doc_id, the counts, votes, base_failed, p_good, kept.

    The counts are written once; Spark counts the vote patterns, the driver fits the
    bounded table of patterns, and their posteriors are joined back by broadcast.
    """
    voted = stage(votes(text_counts(docs.select(F.col("doc_id").cast("long"), "text"))))
    return _decide(voted, fit(voted), keep_at, min_words, max_repeat_pct)


def kept_documents(docs: DataFrame, keep_at: float = 0.5, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Texts are read twice and never shuffled: once for the vote patterns, once to decide
    each row from its own counts.
    """
    patterns = votes(text_counts(docs.select(F.lit(0).alias("doc"), "text")))
    posteriors = fit(patterns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    voted = votes(text_counts(docs.select(whole, "text")))
    return _decide(voted, posteriors, keep_at, min_words, max_repeat_pct).where("kept").select("doc.*")
