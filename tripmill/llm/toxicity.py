"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms (full-width and styled letters) to plain ones,
lower case, marks that combine and signs of no width away, look-alike letters to Latin
ones, digits and signs that stand for letters to those. The lexicon (whole words and word beginnings, weighted
by log odds) and the exception phrases (a lexicon term with a neighbour word that only
clean documents hold) are learned from labelled documents; a logistic curve turns the
matched weight, also normalised by length, into a score.

At most FIT_ROWS labelled documents are used for the fit, in order of the hash of their
id, which bounds the lexicon too; every document is scored on its whole text.

Defined cases: null and empty texts have no matches and get the score of that. Repeated
rows are scored row by row. Labels without a document are not used; of labels that
repeat a document the largest counts. Other columns are not read. An empty table gives
no rows; without labels of both kinds every score is the share of toxic labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, stage, tidy

FIT_ROWS, MIN_DOCS, MIN_ODDS = 8_000, 4, 2.0
PREFIXES = (4, 5, 6, 7, 8)
#: Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKES = str.maketrans(
    {"а": "a", "в": "b", "е": "e", "і": "i", "ѕ": "s", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
     "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k"}
)
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
_SUBSTITUTE = re.compile(r"[01345789@$!|](?=[01345789@$!|]*[^\W\d_])")
_HIDDEN = re.compile(r"[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]+")
_WORD = re.compile(r"[^\W_]+")


def fold_text(text: str | None) -> list[str]:
    """Folded words of a whole text."""
    low = (text or "").lower()
    if not low.isascii():
        low = _HIDDEN.sub("", unicodedata.normalize("NFKC", low)).lower().translate(_LOOKALIKES)
    return _WORD.findall(_SUBSTITUTE.sub(lambda m: _LEET[m.group()], low))


def _terms(words: list[str]) -> set[str]:
    """Whole words as " w " and word beginnings as " p"."""
    distinct = set(words)
    out = {f" {w} " for w in distinct}
    for n in PREFIXES:
        out.update(" " + w[:n] for w in distinct if len(w) > n)
    return out


class Lexicon:
    """Matcher of weighted terms; the automaton is built where it is used."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.weights, self.exceptions, self._automaton = weights, exceptions, None

    def hits(self, words: list[str]) -> list[tuple[str, str, str]]:
        """(term, phrase with the word before, phrase with the word after) of each word
        that a term fits; of several terms at a word the heaviest."""
        if not self.weights or not words:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (weight, term))
            self._automaton.make_automaton()
        line = " " + " ".join(words) + " "
        best: dict[int, tuple[float, str]] = {}
        for end, (weight, term) in self._automaton.iter(line):
            at = end - len(term) + 1
            if at not in best or (weight, term) > best[at]:
                best[at] = (weight, term)
        out = []
        for at, (_, term) in sorted(best.items()):
            close = line.index(" ", at + 1)
            word = line[at + 1 : close]
            before = line[line.rfind(" ", 0, at) + 1 : at] if at else ""
            after = line[close + 1 : line.find(" ", close + 1)] if close + 1 < len(line) else ""
            out.append((term, f"{before} {word}", f"{word} {after}"))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the matched weight, and matched weight by the root of the length."""
        words = fold_text(text)
        total = sum(self.weights[t] for t, b, a in self.hits(words) if b not in self.exceptions and a not in self.exceptions)
        return float(np.log1p(total)), total / max(len(words), 1) ** 0.5


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most FIT_ROWS labelled training documents."""
    told = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    told = told.where(fold(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(told), "doc_id").select("text", F.col("toxic").cast("int")))


def _counted(sample: DataFrame, of) -> DataFrame:
    """(term, toxic, clean): documents of either label that hold each key of(words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[0 if toxic else 1].update(of(fold_text(text)))
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], names=["term", "toxic", "clean"]
        )

    each = sample.mapInArrow(tidy(run), "term string, toxic long, clean long")
    return each.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the logistic coefficients (constant, two features)."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t, c = n.get(1, 0), n.get(0, 0)
    if not t or not c:
        p = (t + 0.5) / (t + c + 1)
        return Lexicon({}), np.array([np.log(p / (1 - p)), 0, 0])
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    best = (
        _counted(sample, _terms).where(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
        .select("term", "odds").collect()
    )
    plain = Lexicon({r["term"]: float(r["odds"]) for r in best})
    phrases = _counted(sample, lambda words: {p for _, b, a in plain.hits(words) for p in (b, a)})
    exceptions = phrases.where("toxic = 0 AND clean >= 3").select("term").collect()
    lexicon = Lexicon(plain.weights, frozenset(r["term"] for r in exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [lexicon.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

    rows = sample.mapInArrow(tidy(run), "a double, b double, toxic int").toPandas()
    return lexicon, fit_logistic(rows[["a", "b"]].to_numpy(), rows["toxic"].to_numpy())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression with a constant."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    x, y = np.column_stack([np.ones(len(x)), x])[order], y[order]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    lexicon, w = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = shared.value
        for batch in batches:
            f = np.array([lexicon.features(x) for x in batch.column(2).to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(w[0] + f @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(
        tidy(run), "doc_id long, held_out boolean, score double"
    )
