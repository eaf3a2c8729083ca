"""The bootstrap of personal data: unseen identifiers, and the pattern graph in plain Python."""

import math
import re

import numpy as np
import pytest

from tripmill.llm import pii

FORM, BASE = re.compile(pii.FORMS.replace("\\p{L}", "[^\\W\\d_]")), re.compile(r"@|^[0-9 .+()-]{10,}$")


def texts(n=240):
    """(texts, planted): labels that digests stand behind in most places, and in the others
    values that neither a base pattern nor a form matches; numbers in prose beside them."""
    rng = np.random.default_rng(2)
    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k)) + "a7"
    odd = [lambda: f"zx-{rng.integers(10, 99)}-qq{rng.integers(100, 999)}", lambda: f"{rng.integers(1000, 9999)}/kl", lambda: f"mr{rng.integers(10**5, 10**6)}"]
    out, planted = [], set()
    for k in range(n):
        label = ("session key", "member ref", "access code")[k % 3]
        if k % 8 == 0:
            value = odd[k // 8 % 3]()
            planted.add(value)
        else:
            value = hexed(38)
        prose = " ".join(f"word{i} holds {rng.integers(1, 500)} items" for i in rng.integers(0, 9, 6))
        out.append(f"{prose} and the {label}: {value} was noted, {prose}")
    return out, planted


@pytest.fixture(scope="module")
def docs(spark):
    rows, planted = texts()
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), planted


def test_unseen_identifiers_are_found_behind_known_labels(docs):
    df, planted = docs
    found = {s.match for r in pii.find_pii(df).collect() for s in r.spans if s.kind == "id"}
    unseen = {m for m in found if not FORM.search(m) and not BASE.search(m)}
    assert unseen == planted and len(planted) == 30


def plain_bootstrap(pairs, rounds):
    """bootstrap() over (match, known, pattern) rows, one after the other."""
    graph = {}
    for match, known, pattern in pairs:
        graph[match, pattern] = graph.get((match, pattern), False) or known
    for left in range(rounds, 0, -1):
        state = {}
        for (m, _), k in graph.items():
            state[m] = state.get(m, False) or k
        n, k = len(state), sum(state.values())
        held = {}
        for (m, p), x in graph.items():
            held.setdefault(p, []).append(x)
        kept = {}
        for p, xs in held.items():
            c, h, z = len(xs), sum(xs), pii.Z
            share = h / c
            least = (share + z * z / (2 * c) - z * math.sqrt(share * (1 - share) / c + z * z / (4 * c * c))) / (1 + z * z / c)
            others = (k - h) / (n - c) if c < n else 0.0
            if least >= pii.LEAST_SHARE and least > others:
                kept[p] = math.log((c - h + 0.5) / (c + 1))
        found = set()
        for m in state:
            own = [p for (x, p) in graph if x == m]
            support = max(sum(p in kept and p.startswith(f"{s} ") for p in own) for s in ("L", "LL", "LR", "LS"))
            doubts = [kept[p] for p in own if p in kept]
            if doubts and math.exp(sum(doubts)) <= 1 - pii.MIN_CONFIDENCE and 2 * support >= sum(p.startswith("L ") for p in own):
                found.add(m)
        if left == 1:
            return found
        more = {(m, p): x or m in found for (m, p), x in graph.items()}
        if more == graph:
            return found
        graph = more


def test_the_graph_equals_a_plain_version_over_three_rounds(spark, docs):
    extra = [(1000 + k, f"see member id a{k}b then ref code c{k % 40}d and id e{k}f") for k in range(60)]
    df = docs[0].unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    scanned = pii.scan(df)
    pairs = [(x.span.match, x.seed, p) for r in scanned.collect() for x in r.extracted for p in x.patterns]
    for rounds in (1, 2, 3):
        got = {r.match for r in pii.bootstrap(scanned.select("extracted"), rounds).collect()}
        assert got == plain_bootstrap(pairs, rounds)
    assert len(plain_bootstrap(pairs, 3)) >= 100
