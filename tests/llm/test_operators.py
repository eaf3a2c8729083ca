"""The corpus operators on odd rows, empty tables and brute-force comparisons."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tripmill.llm import bpe, chat, components, decontaminate, language_id, ngram_lm, overlap, pii, quality, queries, simhash, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row string, spans string, kept string, `row number` string, base string, extracted string, digest string"
WORDS = [f"w{k}x" for k in range(400)]


def long_text(k: int, n: int = 120) -> str:
    rng = np.random.default_rng(k)
    return " ".join(WORDS[i] for i in rng.integers(0, 400, n)) + ".\nThe end is near to us all"


TEXTS = [None, "", "   \n\t ", long_text(1), long_text(1), long_text(2), "x " * 30000, "Ünï wörd\x1c odd \u2003space  two\n\n \n x", long_text(3).replace(" ", "  ")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else "fr", None, None, 1.0, *"abcdefgh") for k, t in enumerate(TEXTS)]
    rows += [rows[3], (None,) * 14, (None, long_text(4), None, "s", 3, *[None] * 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(long_text(2).split()[20:50])), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(9)] + [(None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_odd_and_empty_tables(spark, docs, empty, benchmark, labels):
    path, pattern = queries.tokenizer()
    n = len(TEXTS) + 3
    runs = {
        "quality": lambda d: quality.judge(d), "lm": ngram_lm.score, "toxic": lambda d: toxicity.score(d, labels),
        "lang": language_id.identify, "simhash": simhash.near_duplicates, "pii": pii.find_pii, "bpe": lambda d: bpe.encode(d, path, pattern),
        "redact": pii.redact,
    }
    for name, run in runs.items():
        assert run(docs).count() == n, name
        assert run(empty).count() == 0, name
    assert decontaminate.find_leaks(docs, benchmark).select("doc_id", "item_id").collect() == [(5, 1)]
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, benchmark).columns == docs.columns
    assert toxicity.score(docs, labels.limit(0)).count() == n
    assert quality.kept_documents(docs).columns == docs.columns
    assert simhash.one_of_each(docs).columns == docs.columns


def test_url_rules(spark):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    urls = [("http://A.Example.COM/en/7x?q", "example.com/en/7", "allow"), ("x://com/en/1", "com/en/", "block"), (None, None, "allow"), ("no scheme/en/", None, "allow"),
            ("http://badexample.net/de/8", "net/de/", "allow"), ("http://example.net/de/8#a", "example.net/de/8", "block"), ("http://x.org:80/es/", None, "allow")]
    df = spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(urls)], "page_id long, url string")
    want = [(k, r, v) for k, (_, r, v) in enumerate(urls)]
    for limit in (100, 0):  # broadcast and salted join
        got = url_filter.filter_urls(df, rules, broadcast_rules=limit).orderBy("page_id").select("page_id", "rule", "verdict").collect()
        assert [tuple(g) for g in got] == want
    assert url_filter.filter_urls(df, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_quality_counts():
    text = "a b c d a b c\nsame line\nsame line\n  \n# x|y"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    got = dict(zip(quality.COUNTS, quality._counts(text)))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == 2 and got["n_dup_lines"] == 1 and got["n_repeat_words"] == 6


def test_simhash_equals_brute_force(spark):
    base = long_text(7, 300).split()
    texts = [" ".join(base[:k] + ["edit"] * (k % 3) + base[k:]) for k in range(0, 300, 7)] + [long_text(k) for k in range(20)] + ["", None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [fp(t) for t in texts]
    comp = list(range(len(fps)))
    for _ in fps:
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    for i, r in got.items():
        assert r.fp % (1 << 64) == fps[i] and r.component_id == comp[i]


def test_hot_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(0)
    fps = np.unique(np.concatenate([[5], 5 ^ (1 << rng.integers(0, 20, 300)) ^ (1 << rng.integers(0, 20, 300))])).astype(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    whole = {tuple(sorted(r)) for r in simhash.components(simhash.links(df)).collect()}
    split = {tuple(sorted(r)) for r in simhash.components(simhash.links(df, limit=8)).collect()}
    assert whole == split and len({min(r) for r in whole}) == 1


def test_stage_links_all_similar_texts(spark):
    rng = np.random.default_rng(1)

    def edited(words, k):
        return " ".join("new%d" % rng.integers(10**9) if i in set(rng.integers(0, len(words), k)) else w for i, w in enumerate(words))

    bases = [long_text(50 + k, 200).split() for k in range(8)]
    texts = [edited(b, k) for b in bases for k in (0, 2, 3, 4, 6, 9)] + [long_text(50, 200).upper(), "a b", "A  b", "c", "", None]
    texts += [edited(bases[0], int(k)) for k in rng.integers(0, 12, 60)]  # a hot group
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    fps = [simhash.fingerprint(t) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3 or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in range(len(texts)) if near(i, j)) for i in range(len(texts))]
    want = {i for i, c in enumerate(comp) if i == c}
    assert want < {r.doc_id for r in simhash.one_of_each(df).collect()}
    # the stage takes only links of similar sets, whatever the fingerprints say
    alike = lambda i, j: sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0
    own = list(range(len(texts)))
    for _ in texts:
        own = [min(own[j] for j in range(len(texts)) if alike(i, j)) for i in range(len(texts))]
    kept = {i for i, c in enumerate(own) if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()} == kept
    scanned = overlap.stage(overlap.scan(df))
    for limit, chunk in ((10_000, 256), (1, 256), (4, 16)):  # pairs, groups in one block and in many
        found = overlap.links(df, scanned, limit, chunk)
        named = overlap._named(scanned.select("doc_id", "fp"), 3, 6, found).collect()
        assert {r.doc_id: r.component_id for r in named} == dict(enumerate(comp))
        if limit != 4:
            continue
        linked, _ = overlap.class_links(df, scanned, limit, chunk, overlap._proposed(scanned, 3, 6))
        whole = overlap.name_components(scanned.select("doc_id", F.coalesce("cls", F.lit(0)).alias("fp")), linked).collect()
        assert {r.doc_id: r.component_id for r in whole} == dict(enumerate(own))
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_the_stage_runs_no_step_without_effect(spark, monkeypatch):
    """Fingerprints can only propose what the shingle sets link anyway, so the stage makes none."""

    def used(*_):
        raise AssertionError("fingerprints do not change the result")

    base = long_text(90, 200)
    df = spark.createDataFrame([(3, base), (1, base + " more"), (2, long_text(91, 200)), (4, None), (5, " ")], "doc_id long, text string")
    whole, _ = overlap.class_links(df, scanned := overlap.stage(overlap.scan(df)))
    more, _ = overlap.class_links(df, scanned, proposed=overlap._proposed(scanned, 3, 6))
    groups = lambda links: {tuple(r) for r in overlap.components(links).collect()}
    assert groups(whole) == groups(more) and len(groups(whole)) == 2
    monkeypatch.setattr(simhash, "links", used)
    monkeypatch.setattr(overlap, "_proposed", used)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()} == {1, 2, 4}


def test_bpe_equals_the_library(spark, docs):
    import tiktoken

    path, pattern = queries.tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = [*TEXTS, " lead", "trail ", "a  b", "it's 12\t3 'll\u00a0 ½ x", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path, pattern), path).collect():
        want = enc.encode_ordinary(odd[r.doc_id] or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert bytes(r.decoded).decode() == (odd[r.doc_id] or "")


def test_passes_that_differ_stop_the_job(spark):
    path, pattern = queries.tokenizer()
    rows = [(k, long_text(k, 30)) for k in range(40)]
    unstable = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).orderBy(F.rand())  # each pass has its own order
    clock = F.udf(lambda t: f"{t} {time.time_ns()}").asNondeterministic()
    for plan in (unstable.withColumn("text", clock("text")), unstable.sortWithinPartitions(clock("text"))):
        plan = plan.select("doc_id", clock("text").alias("text"))
        for run in (lambda d: bpe.encode(d, path, pattern), ngram_lm.score):
            with pytest.raises(Exception, match="two passes over docs differ"):
                run(plan).collect()


def test_lm_mass_and_base(spark):
    texts = [long_text(k % 7, 40) for k in range(40)]
    out = ngram_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_chat_folds_and_reads_back(spark):
    events = [("message", "1", "user", "hi ### \\ </turn>"), ("message", "2", "assistant", "a"), ("delta", "2", None, "b"), ("message", "3", "user", "x"),
              ("regenerate", "2", None, None), ("delta", "2", None, "new"), ("edit", "1", None, "ed:it\\")]
    final = [("user", "ed:it\\"), ("assistant", "new")]
    assert chat.fold_events(events) == final
    tricky = [("us:er", "\\### Assistant: </turn> ok"), ("assistant", "</turn>\n### user: "), ("", "")]
    text, spans = chat.render(tricky)
    assert chat.read_back(text) == tricky and [chat.unescape(text[a:b]) for a, b in spans] == [tricky[1][1]]
    rows = [(1, k, *e) for k, e in enumerate(events)] + [(None, 1, "message", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in final).encode()).hexdigest()
    assert got[None].n_turns == 1 and chat.format_chats(df.limit(0)).count() == 0


def test_pii_spans_and_bootstrap(spark):
    texts = ["a@b.c@d.e_f@g.h.i", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "é +1 (23) 456-7890 x@é.com", "9" * 20000, "4111 1111 1111 1111-"]
    want = ["email:0:5,email:6:17", "ip:0:7,ip:8:15,ip:26:37", "phone:2:18", "", "card:0:19"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii.span_text(pii.F.col("base")).alias("s")).collect()}
    assert [got[k] for k in range(5)] == want
    seeds = [(k, f"please write to account holder u{k}@mail.org today") for k in range(30)]
    unseen = [(100 + k, f"please write to account holder AB-{k}77 today") for k in range(3)]
    spans = pii.find_pii(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).select("doc_id", pii.span_text(pii.F.col("spans")).alias("s"))
    found = {r.doc_id: r.s for r in spans.collect()}
    assert all(found[100 + k].startswith("id:31:") for k in range(3))


def test_pii_contexts_are_cut_at_white_space(spark):
    def found(seed, unseen):
        rows = [(k, seed(k, f"u{k}@mail.org")) for k in range(60)] + [(100 + k, unseen(k, f"AB-{k}77")) for k in range(3)]
        got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.F.col("spans.match").alias("m")).collect()
        return [r.m for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id >= 100]

    want = [[f"AB-{k}77"] for k in range(3)]
    line = lambda k, x: f"prev{chr(97 + k % 26)}{chr(97 + k // 26)}.\nid: {x}\nnext"
    assert found(line, line) == want
    row = lambda k, x: f"{chr(97 + k % 26)}{chr(97 + k // 26)}\tid\t{x}\tend"
    assert found(row, row) == want
    assert contexts(spark, "my passport is 77") == ["LL passport is", "L is", "LR is _ ", "LS is 9~1"]
    assert contexts(spark, "x\n\tpassport =\n'77'!") == ["LL x passport=", "L passport=", "LR passport= _ !", "LS passport= 9~1"]
    assert contexts(spark, "of key:77, and") == ["LL of key:", "L key:", "LR key: _ and", "LS key: 9~1"] and contexts(spark, "77 x") == []


def contexts(spark, text):
    df = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return df.first().extracted[0].patterns


def test_decontamination_finds_paraphrases(spark, benchmark):
    words = long_text(2).split()[20:50]
    words[7] = "changed"
    filler = long_text(9).split()
    df = spark.createDataFrame([(1, " ".join(filler[:40] + words + filler[40:60])), (2, long_text(11))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find_leaks(df, benchmark).collect()] == [1]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passages = [long_text(200 + k).split()[: 15 + 2 * k] for k in range(20)]
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, text string")
    texts = []
    for k in range(120):
        p = list(passages[k % 20])
        for i in rng.choice(len(p), int(len(p) * rng.uniform(0, 0.2)), replace=False):
            p[i] = f"other{rng.integers(10**6)}"
        filler = [f"v{x}" for x in rng.integers(0, 5000, 200)]
        cut = int(rng.integers(0, 150))
        texts.append(" ".join(filler[:cut] + (p if k % 3 else []) + filler[cut:]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(passages) if plain_lcs(p, t.split()) >= 0.75 * len(p)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, items).collect()}
    assert want and got >= want and {d for d, _ in got} == {d for d, _ in want}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)  # several blocks
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 4)  # most words outside the fit
    again = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, items).collect()}
    assert len(again & want) >= 0.9 * len(want) and {d for d, _ in again} <= {d for d, _ in want}
    left = {r.doc_id for r in decontaminate.without_leaks(df, items).collect()}
    assert left == set(range(120)) - {d for d, _ in again}


def test_toxic_words_are_folded():
    assert toxicity.fold_text("1D10T сlоwn $tupid 12 a$$") == ["idiot", "clown", "stupid", "12", "a"]
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " clow": 2.0}, frozenset({"clowns fish"}))
    assert lexicon.features("an 1d1ot")[0] == pytest.approx(np.log1p(3.0)) and lexicon.features("clowns fish")[0] == 0


def test_language_windows_cover_all_bytes():
    for n in (1, 255, 256, 257, 258, 509, 510, 1000):
        w = language_id.windows("a" * n, language_id.STRIDE)
        assert (w == 97).any(axis=1).all() and len(w) * language_id.STRIDE + 3 >= n
    assert language_id.Network(["en"]).predict([None, "", "123 --", "abc"])[:3] == [("und", 0.0)] * 3


def test_stages_keep_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_pipeline_on_odd_and_empty_tables(spark, docs, empty, benchmark, tmp_path):
    """Each stage against a plain version of what it decides, on whole rows."""
    path, pattern = queries.tokenizer()
    good = [f"The report of {k} says that the people in our town like to read and write about it. " * 1 + long_text(300 + k, 60) for k in range(6)]
    mail = good[5] + " write to ann@mail.org now"
    leak = good[4] + " " + " ".join(long_text(2).split()[20:50])
    rows = [(100 + k, t, "en", "web", len(t), 1.0, *"abcdefgh") for k, t in enumerate([*good[:4], good[0], leak, mail])]
    rows.append((None, good[3] + " x", "en", None, None, None, *[None] * 8))
    whole = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    for name, df in (("odd", whole), ("empty", empty)):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for step, function in corpus_pipeline.STAGES[:-1]:
            before, now = now, corpus_pipeline.stage(function(spark, now, folder))
            assert now.columns == df.columns, step
            ids, kept = ([r.doc_id for r in x.select("doc_id").collect()] for x in (before, now))
            if step == "near_duplicates" and name == "odd":
                assert 104 not in kept and {100, 101, 102, 103} <= set(kept) and set(kept) <= set(ids)
            if step == "decontamination":
                leaks = {r.doc_id for r in decontaminate.find_leaks(before, benchmark).collect()}
                assert set(kept) == set(ids) - leaks and (name == "empty" or leaks == {5, 105})
            if step == "personal_data":
                assert sorted(map(str, ids)) == sorted(map(str, kept))
                texts = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
                assert name == "empty" or texts[106] == (mail.replace("ann@mail.org", "[email]"), len(mail) - 5)
        last = corpus_pipeline.run(spark, folder) if name == "empty" else corpus_pipeline.token_stage(spark, now, folder)
        decoded = sorted(r.decoded_sha256 for r in last.collect())
        assert decoded == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in now.collect())


def test_a_large_class_is_named_salted(spark, monkeypatch):
    texts = [long_text(1)] * 40 + [long_text(1) + " x", long_text(2), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    monkeypatch.setattr(simhash, "HOT_CLASS", 10)
    assert {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()} == plain


def test_quality_em_equals_a_plain_one(spark):
    texts = [long_text(k, 80) for k in range(30)] + ["# % | & " * 30 + long_text(k, 60) for k in range(6)] + ["same words here " * 40, None, "short"]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    rules = list(quality.RULES)
    voters = [[rows[k][f"vote_{r}"] for r in rules] for k in rows if rows[k].n_words]
    prior, table = 0.8, [[[0.4, 0.3, 0.3]] * len(rules), [[0.1, 0.2, 0.7]] * len(rules)]

    def posterior(votes):
        like = [1 - prior, prior]
        for c in (0, 1):
            for r, v in enumerate(votes):
                like[c] *= table[c][r][v + 1]
        return like[1] / sum(like)

    for _ in range(60):
        post = [posterior(v) for v in voters]
        new = [[[(sum(q if c else 1 - q for q, v in zip(post, voters) if v[r] == k) + 1) / (sum(q if c else 1 - q for q in post) + 3) for k in (-1, 0, 1)] for r in range(len(rules))] for c in (0, 1)]
        prior, table = min(max(sum(post) / len(post), 0.05), 0.98), new
    for r in range(len(rules)):
        if table[1][r][2] < table[0][r][2] and table[1][r][0] > table[0][r][0]:
            table[0][r] = table[1][r] = [(x + y) / 2 for x, y in zip(table[0][r], table[1][r])]
    for k, r in rows.items():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        p = posterior([r[f"vote_{x}"] for x in rules])
        assert r.base_failed == failed and r.p_good == pytest.approx(p, abs=1e-9) and r.kept == (not failed and p >= 0.5)


def test_lm_equals_a_plain_one(spark):
    import math
    import zlib

    texts = [long_text(k % 9, 30).lower() for k in range(60)] + [None, " ", "Only Here onlyhere"]
    tokens = [[*(t or "").lower().split(), "</end>"] for t in texts]
    role = [zlib.crc32(str(k).encode()) % 5 for k in range(len(texts))]
    uni, bi, rest_uni, rest_bi, held = {}, {}, {}, {}, {}
    for words, f in zip(tokens, role):
        for before, w in zip(["<s>", *words], words):
            for into, ok in ((bi, f != 1), (rest_bi, f > 1), (held, f == 0)):
                if ok:
                    into[before, w] = into.get((before, w), 0) + 1
        for w in ["<s>", *words]:
            for into, ok in ((uni, f != 1), (rest_uni, f > 1)):
                if ok:
                    into[w] = into.get(w, 0) + 1
    total, v = sum(n for w, n in uni.items() if w != "<s>"), len([w for w in uni if w != "<s>"])
    rest_total = sum(n for w, n in rest_uni.items() if w != "<s>")
    bucket = lambda c: min(int(math.log2(c)) + 1, ngram_lm.BUCKETS - 1) if c else 0
    weights = [[0.0, 0.9, 0.1]] + [[0.5, 0.4, 0.1]] * (ngram_lm.BUCKETS - 1)
    for b in range(ngram_lm.BUCKETS):
        # the operator bins pairs by logarithms of their probabilities; here each is by itself
        here = [(n, rest_bi.get(p, 0) / max(rest_uni.get(p[0], 0), 1), rest_uni.get(p[1], 0) / max(rest_total, 1), 1 / (v + 1)) for p, n in held.items() if bucket(rest_uni.get(p[0], 0)) == b]
        if not here:
            weights[b] = weights[b - 1] if b > 1 else weights[b]
            continue
        w = list(weights[b])
        for _ in range(80):
            new = [0.01 if b or k else 0.0 for k in range(3)]
            for n, *p in here:
                mixed = sum(x * y for x, y in zip(w, p))
                new = [a + n * x * y / mixed for a, x, y in zip(new, w, p)]
            w = [x / sum(new) for x in new]
        weights[b] = w
    got = {r.doc_id: r for r in ngram_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, words in enumerate(tokens):
        base = sum(math.log10((uni.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in words)
        score = 0.0
        for before, w in zip(["<s>", *words], words):
            c = uni.get(before, 0)
            a = weights[bucket(c)]
            score += math.log10(a[0] * bi.get((before, w), 0) / max(c, 1) + a[1] * uni.get(w, 0) / total + a[2] / (v + 1))
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (role[k] == 1, len(words), sum(uni.get(w, 0) > 0 for w in words), total)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, rel=0.02)


def test_lexicon_matches_as_a_plain_search():
    lexicon = toxicity.Lexicon({" bad ": 2.0, " bad": 1.5, " worst": 3.0, " wor": 1.0, " is bad": 9.0}, frozenset({"not bad"}))
    for text in ("bad", "not bad", "badly worse WORST", "so b@d, w0rst", "", None, "x" * 50, "bad bad not bad badbad"):
        words = toxicity.fold_text(text)
        total = 0.0
        for i, w in enumerate(words):
            fits = [x for t, x in {" bad ": 2.0, " bad": 1.5, " worst": 3.0, " wor": 1.0}.items() if (t == f" {w} " or (not t.endswith(" ") and w.startswith(t[1:])))]
            if w == "is" and i + 1 < len(words) and words[i + 1].startswith("bad"):
                fits.append(9.0)
            if fits and not (i and f"{words[i - 1]} {w}" == "not bad"):
                total += max(fits)
        assert lexicon.features(text) == pytest.approx((np.log1p(total), total / max(len(words), 1) ** 0.5))
    assert toxicity.fold_text("ｉｄｉｏｔ i\u200bd\u0301iot !diot |diot 8ad") == ["idiot", "idiot", "idiot", "idiot", "bad"]


def test_fast_convolution_equals_the_plain_one_and_learns():
    network = language_id.Network(["a", "b"], seed=3)
    x = np.random.default_rng(1).integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8)
    pooled = []
    for w, table, bias in zip(language_id.WIDTHS, network.tables, network.bias):
        n = language_id.WINDOW - max(language_id.WIDTHS) + 1
        z = np.array([[sum(table[j][row[i + j]] for j in range(w)) + bias for i in range(n)] for row in x])
        pooled.append(z.max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ network.out + network.out_bias
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert network.log_probabilities(x) == pytest.approx(want, abs=1e-4)
    texts = ["le chat est dans la maison avec nous " * 3, "the cat is in the house with all of us " * 3] * 100
    train = np.stack([language_id.windows(t[k % 7 :], language_id.STRIDE)[0] for k, t in enumerate(texts)])
    taught = language_id.Network(["fr", "en"])
    taught.train(train, np.array([0, 1] * 100))
    assert [p[0] for p in taught.predict(["la maison avec le chat est " * 5, "the house is with all cats " * 5])] == ["fr", "en"]


def test_pii_base_equals_a_plain_search(spark):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True,
                "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    rng = np.random.default_rng(5)
    alphabet = list("aB9.@-+ ()\u00e9\n01234567") + ["4111 1111 1111 1111", "10.0.0.1", "a.b@c.de", "+1 (234) 555-1234", "token = "]
    texts = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(n))) for n in rng.integers(0, 300, 80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", pii.span_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()}
    for k, t in enumerate(texts):
        found = [(m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "", re.A) if passes(kind, m.group())]
        assert got[k] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)), t


def test_pii_tokens_apart_and_redaction(spark):
    """Tokens against a quadratic overlap test; redaction against slices."""
    rng = np.random.default_rng(6)
    parts = ["10.0.0.1", "x@y.org", "a1", "10.0.0.1x", "key:77", "k=z9!", "word", "(v2)", "9"]
    texts = [" ".join(parts[i] for i in rng.integers(0, len(parts), int(n))) for n in (0, 1, 3, 40, 700)]
    rows = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    token = re.compile(r"(?<![^\s\"'<>=])[^\s\"'<>=]*[0-9][^\s\"'<>=]*|(?<==)[^\s\"'<>=]{4,}")
    for r in rows:
        want = []
        for m in token.finditer(r.text):
            cut = re.match(r"(?:[A-Za-z_-]+:)?[\W_]*", m.group()).end()
            value = re.sub(r"[\W_]+$", "", m.group()[cut:])
            a = m.start() + cut
            if value and not any(s.start < a + len(value) and a < s.end for s in r.base):
                want.append((a, a + len(value), value))
        assert [(x.span.start, x.span.end, x.span.match) for x in r.extracted if not x.base] == want
        spans = [(s.start, s.end, s.kind) for s in r.base] + [(a, b, "id") for a, b, _ in want]
        plain, at = "", 0
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= at:
                plain += r.text[at:a] + f"[{kind}]"
            at = max(at, b)
        schema = "text string, spans array<struct<start:int,end:int,kind:string,match:string>>"
        df = spark.createDataFrame([(r.text, [(a, b, kind, "") for a, b, kind in spans])], schema)
        assert df.select(pii._replaced(F.col("text"), F.col("spans")).alias("t")).first().t == plain + r.text[at:]


def test_pii_redacts_what_it_discovers(spark):
    secret = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'{"abcdefgh"[k % 8]} word, token = "{secret(k)}" and more') for k in range(40)]
    rows += [(100, 'see token = "zz-top-9"'), (101, 'see token = "correct-horse"'), (102, "version 3."), (103, None), (104, 'see token = "zz-top-9"')]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 'a word, token = "[id]" and more' and got[100] == got[104] == 'see token = "[id]"' and got[101] == 'see token = "[id]"'
    assert got[102] == "version 3." and got[103] is None


def test_decontamination_buckets_are_those_of_each_plain_word():
    texts = ["", None, "  Ab, (ab) \t-- 'Straße!' «Straße» ÉTÉ.\n" + "z" * 70_000, " x\fX\v ...x "]
    codes, words = decontaminate.coded(pa.array(texts, pa.string()))
    assert words.tolist() == [len(decontaminate._raw_words(t)) for t in texts]
    plain = [decontaminate._plain(w) for t in texts for w in decontaminate._raw_words(t)]
    assert codes.tolist() == decontaminate._hashed(pa.array(plain, pa.binary())).tolist()
    assert [c == 0 for c in codes] == [not w for w in plain] and len(set(codes.tolist())) == len(set(plain))
    many = [f"w{k}" for k in range(70_000)]  # more than are hashed at once
    found = decontaminate.coded(pa.array([" ".join(many)]))[0]
    assert found[-1] == decontaminate.coded(pa.array([many[-1]]))[0][0]
    assert 0.95 < len(np.unique(found)) / (2**18 * (1 - np.exp(-70_000 / 2**18))) < 1.05
    assert [len(p) for p in decontaminate._pieces(pa.array(["a" * 3_000_000, None, "b", "c" * 2_500_000]))] == [1, 2, 1]


def test_components_equal_a_plain_search_with_salted_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_STAR", 20)
    rng = np.random.default_rng(5)
    pairs = [(7, 1000 + k) for k in range(60)] + [(1000 + k, 1100 + k) for k in range(30)]  # a star with tails
    pairs += [(k, k + 1) for k in range(300, 340)]  # a path
    pairs += [tuple(p) for p in rng.integers(-500, 0, (300, 2)).tolist()] + [(5, 5), (7, 1000)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(want) and {r.node: r.root for r in found} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
