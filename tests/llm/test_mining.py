"""Hard negatives, fill-in-middle and licence scans against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmill.llm import fill_in_middle as fim
from tripmill.llm import hard_negatives as hn
from tripmill.llm import licenses, queries

# -- hard negatives -----------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, rank string, score double, near string, qid string"


def brute(rows, is_anchor, n_pos=5, n_neg=10, low=30, high=90):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        usable[i, label, tuple(whole)] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in usable:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b) for b in usable)
        pos = [(s, i) for s, i, b in scored if b[1] == a[1] and b != a][:n_pos]
        for ps, pid in pos:
            ps = -ps
            neg = [(-s, i) for s, i, b in scored if b[1] != a[1] and low * ps <= -100 * s <= high * ps][:n_neg]
            out |= {(a[0], pid, k + 1, i, ps, s) for k, (s, i) in enumerate(neg)}
    return out


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("CHUNK", 40), ("STEP", 8), ("FIRST", 20), ("SAMPLE", 50)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(k, int(rng.integers(0, 3)), [float(x) for x in centre[k % 4] + 0.3 * rng.normal(size=6)]) for k in range(150)]
    rows += [(k, k % 2, rows[20][2]) for k in range(200, 260)]  # many copies of one vector
    rows += [rows[10], rows[20], (10, 2, rows[10][2]), (None, 1, rows[0][2]), (300, None, rows[0][2]), (310, 1, None), (320, 1, [1.0, None]), (330, 1, [math.nan] * 6),
             (340, 1, [math.inf] * 6), (350, 1, []), (360, 0, [0.5]), (370, 2, [0.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1.0, None, "q") for r in rows], VECTORS)
    got = [tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0).collect()]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400
    assert hn.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.mine(df, F.lit(False)).count() == 0


def test_visits_fall_and_bounds_hold():
    rng = np.random.default_rng(1)
    b1, b2 = rng.normal(size=9), rng.normal(size=5)
    order = list(hn.visit_order(b1, b2))
    assert len({(i, j) for _, i, j in order}) == 45 and all(a[0] >= b[0] for a, b in zip(order, order[1:]))
    # clustered vectors: the heap stops long before the end, with the same answer
    centre = rng.normal(size=(16, 8)) * 4
    x = np.floor(64 * (centre[rng.integers(0, 16, 6000)] + 0.1 * rng.normal(size=(6000, 8))))
    index = hn.LocalIndex(x, np.zeros(6000, int), [[k] for k in range(6000)], hn.fit_codebooks(x[:500], 16))
    q = x[17]
    question = hn.Question(0, 5, -math.inf, math.inf, -math.inf)
    scored = index.ask(q, 0, True, [question], None, set())
    want = sorted((-int(s), k) for k, s in enumerate(x @ q))[:5]
    assert [(s, i) for s, i, _ in question.best] == want and scored < 3000


# -- fill-in-middle -------------------------------------------------------------------------

MARKS = tuple(s.encode() for s in fim.SENTINELS)


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n<PSM>é\U0001f600", max_size=40), st.integers(0, 10**6))
def test_rotations_equal_concatenation(text, doc_id):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = fim.draws("7", doc_id)
    n, form, prefix, middle, out = fim.transform(text.encode(), h, 100, 50, MARKS)
    assert n == len(units) and h[0] == int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in fim.SENTINELS):
        assert (form, prefix, middle, out) == ("plain", None, None, text.encode())
    else:
        want = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
        assert out.decode() == want and (prefix, middle) == (len(p), len(m)) and form == ("spm" if h[3] % 100 < 50 else "psm")
    assert fim.invert(out, form, MARKS) == text.encode()


def test_reversal_over_several_strips(monkeypatch):
    monkeypatch.setattr(fim, "STRIP", 3)
    for n in range(12):
        for a in range(n + 1):
            data = bytearray(range(n))
            fim.rotate(data, 0, a, n)
            assert bytes(data) == bytes(range(a, n)) + bytes(range(a))


def test_fill_in_middle_of_odd_rows(spark):
    long = "line of text\n" * 40000
    rows = [(1, None), (1, None), (2, ""), (None, "a\nb\nc"), (3, "has <S> inside\n"), (4, long), (5, "\n\n\n"), (5, "\n\n\n")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, output string, form string")
    cut = fim.fill_in_middle(df)
    got = fim.restore(cut).orderBy("doc_id").collect()
    assert sorted(r.restored for r in got) == sorted((t or "") for _, t in rows)
    assert {r.form for r in got if r.doc_id in (1, 2, 3)} == {"plain"} and all(r.form != "plain" for r in got if r.doc_id in (4, 5, None))
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}


# -- licence scans ----------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["GNU general public license", "cc by", "CC-BY", "mit", "license", "apache", "É", "zz", "x" * 20, "1", "_", "\x00", "noncommercial"]), max_size=20), st.sampled_from([" ", "\n", "--"]))
def test_base_phrases_equal_a_plain_search(parts, gap):
    text = gap.join(parts)
    words = WORD.findall(low(text))
    lexicon = licenses.Lexicon()
    index = licenses.Index(lexicon, 10, {}, 8, 3, 0.8)
    n, n_base, first, last, base, labels, score = index.scan(text.encode())
    at, found = [], set()
    for phrase, label in licenses.BASE.items():
        k = len(phrase.split())
        hits = [i for i in range(len(words)) if words[i : i + k] == phrase.split()]
        at += hits
        found |= {label} if hits else set()
    assert (n, n_base, first, last, base) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))
    assert found <= set(filter(None, labels.split(","))) and 0 <= score <= 1
    assert [lexicon.words[c - 1] if c else None for c in lexicon.codes(text.encode())] == [w if w in lexicon.code else None for w in words]


def slow_labels(text, index, accept):
    """Every alignment of every template tried one after the other."""
    codes = index.lexicon.codes(text.encode()).tolist()
    out = set()
    for label, seq, postings, by_idf, wanted in index.templates:
        rare = [c for c in by_idf if c in codes][: index.rare]
        for start in range(-len(seq), len(codes) + 1):
            at = lambda k: codes[start + k] if 0 <= start + k < len(codes) else None
            agree = sum(any(at(k) == c for k in postings[c].tolist()) for c in rare)
            keys = all(any([at(b + k) for k in range(len(key))] == key for b in begin.tolist()) for key, begin in wanted)
            share = sum(index.idf[c] for k, c in enumerate(seq.tolist()) if at(k) == c) / index.idf[seq].sum()
            if agree >= min(index.agree, len(postings)) and keys and share >= accept:
                out.add(label)
    return out


def test_template_labels_equal_trying_all_alignments():
    index = licenses.Index(licenses.Lexicon(), 1000, {"the": 900, "license": 90, "gnu": 40, "work": 300}, 8, 3, 0.8)
    rng = np.random.default_rng(0)
    pool = [t.split() for _, t, _ in licenses.TEMPLATES]
    for _ in range(40):
        words = []
        for _ in range(3):
            t = list(pool[rng.integers(len(pool))])
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(len(t))] = "other"
            words += ["some", "prose"] * int(rng.integers(0, 4)) + t
        text = " ".join(words)
        labels = set(filter(None, index.scan(text.encode())[5].split(",")))
        assert labels - set(licenses.BASE.values()) == slow_labels(text, index, 0.8)


def test_license_scan_of_odd_rows(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [(1, None), (2, ""), (3, notice), (3, notice), (None, "Licensed under CC BY-NC 4.0, see"), (4, "apache " * 50000 + "licence"), (5, "Licensed under the MIT License")]
    df = spark.createDataFrame([(*r, 1.0, "l") for r in rows], "doc_id long, text string, score double, labels string")
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(df).collect()}
    assert got[3, 29].labels == "mit-text" and got[3, 29].base_labels == "" and got[3, 29].score > 0.99
    nc = next(r for r in got.values() if r.doc_id is None)
    assert nc.base_labels == "cc-by" and nc.labels == "cc-by,cc-by-nc-4.0" and nc.first_word == 2
    assert got[4, 50001].labels == "" and got[1, 0].first_word is None
    assert got[5, 5].base_labels == "mit"
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="key phrases"):
        licenses.scan(df, templates=[("x", "some words here", ("other words",))])


def test_registered():
    assert {"op11_hard_negatives", "op12_fill_in_middle", "op13_license_scan"} <= set(queries.QUERIES)


# -- the near-duplicate stage -----------------------------------------------------------------


def test_template_pages_stay_and_copies_go(spark):
    from tripmill.llm import overlap

    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(10**9)
    template = [word() for _ in range(120)]
    pages = [" ".join(template + [word() for _ in range(40)]) for _ in range(300)]  # similarity about 0.58
    base = [word() for _ in range(150)]
    copies = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 150)]  # one word of 150 changed
    df = spark.createDataFrame(list(enumerate(pages + copies)), "doc_id long, text string")
    kept = {r.doc_id for r in overlap.one_of_each(df).collect()}
    assert kept == set(range(300)) | {300}
