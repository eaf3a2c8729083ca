"""Licence scan by a positional index of rare words.

Licence templates are short word sequences with key phrases that must stand in them. A
first pass counts in how many documents each template word occurs. The second looks up,
for each template, the words of the file that are rarest by inverse document frequency;
a place of the word in the file minus its place in the template is an alignment, and the
postings of several words are intersected by such alignments. A candidate alignment is
verified: every key phrase must stand, word by word, where the alignment puts it. Its score
is the share of the template's weight (sum of inverse document frequencies) that stands in place.

Plain phrases (`BASE`) are found beside that at every place where their words follow each
other.

Defined cases: a null text counts as the empty text, which has no words and no labels;
repeated rows are scanned row by row; an empty table gives no rows; ties of frequency go
to the word that is first in the alphabet, ties of score to the alignment that is first
in the file. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

#: Phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, opening words of the published notice, key phrases.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("free software", "gnu lesser general public license")),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("free software", "gnu affero general public license")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance with the license")),
    ("mit-named", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "international license")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of code points beyond ASCII.
_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longest word of a template, so that its first and last eight bytes are the whole of it.
LONGEST = 16


class Lexicon:
    """The words of all templates and phrases, coded from 1 in alphabetic order."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in templates]
        self.base = [(phrase.split(), label) for phrase, label in base.items()]
        words = sorted({w for _, ws, ks in self.templates for w in [*ws, *sum(ks, [])]} | {w for ws, _ in self.base for w in ws})
        if any(len(w.encode()) > LONGEST for w in words):
            raise ValueError(f"template words have {LONGEST} bytes at most")
        self.words = words
        self.code = {w: k + 1 for k, w in enumerate(words)}
        keys = [tuple(int(x[0]) for x in self._keys(np.frombuffer(w.encode(), np.uint8))) for w in words]
        self.slot = {r: k + 1 for k, r in enumerate(keys)}
        self.heads = np.unique(np.array([head for head, _, _ in keys], np.uint64))

    @staticmethod
    def _keys(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last eight bytes and length of each word of a lower-cased text."""
        flag = _WORD[low].view(np.int8)
        edge = np.diff(flag, prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(low) + 1,), "<u8", padded.data, strides=(1,))
        n = ends - starts
        head = eight[starts] & _MASK[np.minimum(n, 8)]
        tail = np.where(n > 8, eight[np.maximum(ends - 8, 0)], 0).astype(np.uint64)
        return head, tail, n

    def codes(self, raw: bytes) -> np.ndarray:
        """The code of each word of raw, 0 for words that no template has."""
        if not raw:
            return np.zeros(0, np.int32)
        head, tail, n = self._keys(_LOWER[np.frombuffer(raw, np.uint8)])
        out = np.zeros(len(n), np.int32)
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        likely = np.flatnonzero((self.heads[at] == head) & (n <= LONGEST))
        if len(likely):
            rows = zip(head[likely].tolist(), tail[likely].tolist(), n[likely].tolist())
            out[likely] = [self.slot.get(r, 0) for r in rows]
        return out


def places(codes: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Starts of the phrase in codes."""
    n = len(codes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(codes[:n] == phrase[0])
    for k, c in enumerate(phrase[1:], 1):
        found = found[codes[found + k] == c]
    return found


class Index:
    """Postings of the templates with weights from document counts, and the scan of a file."""

    def __init__(self, lexicon: Lexicon, documents: int, found: dict[str, int], rare: int, agree: int, accept: float):
        self.lexicon, self.rare, self.agree, self.accept = lexicon, rare, agree, accept
        self.idf = np.array([0.0] + [math.log((documents + 2) / (found.get(w, 0) + 1)) for w in lexicon.words])
        self.templates = []
        for label, words, keys in lexicon.templates:
            seq = np.array([lexicon.code[w] for w in words])
            postings = {int(c): np.flatnonzero(seq == c) for c in dict.fromkeys(seq.tolist())}
            by_idf = sorted(postings, key=lambda c: (-self.idf[c], c))
            keys = [[lexicon.code[w] for w in k] for k in keys]
            wanted = [(k, places(seq, k)) for k in keys]
            if any(not len(p) for _, p in wanted):
                raise ValueError(f"template {label} lacks one of its key phrases")
            self.templates.append((label, seq, postings, by_idf, wanted))
        self.base = [([lexicon.code[w] for w in ws], label) for ws, label in lexicon.base]

    def _align(self, codes: np.ndarray, at: dict[int, np.ndarray], seq, postings, by_idf, wanted) -> float:
        """Best verified score of one template in a file; 0 without any."""
        words = [c for c in by_idf if c in at][: self.rare]
        need = min(self.agree, len(postings))
        if len(words) < need:
            return 0.0
        offsets = [np.unique((at[c][:, None] - postings[c][None, :]).ravel()) for c in words]
        where, votes = np.unique(np.concatenate(offsets), return_counts=True)
        best, total = 0.0, float(self.idf[seq].sum()) or 1.0
        for start in where[votes >= need].tolist():
            if best >= 1.0:
                break
            spots = start + np.arange(len(seq))
            inside = (spots >= 0) & (spots < len(codes))
            score = float(self.idf[seq[inside]][codes[spots[inside]] == seq[inside]].sum()) / total
            if score <= best:
                continue
            for key, begin in wanted:
                hit = any(0 <= start + b <= len(codes) - len(key) and codes[start + b : start + b + len(key)].tolist() == key for b in begin.tolist())
                if not hit:
                    break
            else:
                best = score
        return best

    def scan(self, raw: bytes) -> tuple:
        """(words, base places, first, last, base labels, labels, score) of one file."""
        codes = self.lexicon.codes(raw)
        spots = np.flatnonzero(codes)
        n_base, first, last, base, own, best = 0, None, None, set(), set(), 0.0
        if len(spots):
            for phrase, label in self.base:
                found = places(codes, phrase)
                if len(found):
                    n_base += len(found)
                    base.add(label)
                    first = min(int(found[0]), first if first is not None else int(found[0]))
                    last = max(int(found[-1]), last if last is not None else int(found[-1]))
            order = np.argsort(codes[spots], kind="stable")
            held, begin = np.unique(codes[spots][order], return_index=True)
            at = dict(zip(held.tolist(), np.split(spots[order], begin[1:])))
            for label, *template in self.templates:
                score = self._align(codes, at, *template)
                best = max(best, score)
                if score >= self.accept:
                    own.add(label)
        return len(codes), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), min(best, 1.0)


def _raw(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def document_counts(docs: DataFrame, lexicon: Lexicon) -> tuple[int, dict[str, int]]:
    """Documents in all and by template word; each partition counts before the shuffle,
    and the result has as many rows as the templates have words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(lexicon.words) + 1, np.int64)
        for batch in batches:
            count[0] += batch.num_rows
            for raw in _raw(batch.column(0)):
                codes = np.unique(lexicon.codes(raw))
                count[codes[codes > 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count)), pa.int32()), pa.array(count)], names=["code", "n"])

    found = docs.select("text").mapInArrow(tidy(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    by_code = {r["code"]: r["n"] for r in found}
    return by_code.get(0, 0), {w: by_code.get(k, 0) for w, k in lexicon.code.items()}


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: int = 8, agree: int = 3, accept: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    rare: words of a template that are looked up in a file, its rarest there; agree: how
    many of them must name one alignment; accept: score from which a template counts.
    Two narrow passes over the texts, which are never shuffled.
    """
    lexicon = Lexicon(templates, base)
    index = Index(lexicon, *document_counts(docs, lexicon), rare, agree, accept)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = [index.scan(raw) for raw in _raw(batch.column(1))]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)
