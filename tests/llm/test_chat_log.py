"""The event log of conversations: folding against a plain fold, and the log of given turns."""

import random

from tripmill.llm import chat


def plain_fold(events):
    """Every event applied to a list of (id, role, text), searched from its end."""
    messages = []
    for kind, message, role, text in events:
        at = next((i for i in range(len(messages) - 1, -1, -1) if messages[i][0] == message), None)
        if kind == "message" or at is None:
            messages.append([message, role or "", text or ""])
        elif kind == "delta":
            messages[at][2] += text or ""
        elif kind == "edit":
            messages[at][2] = text or ""
        else:
            messages[at][2] = text or ""
            messages = messages[: at + 1]
    return [(r, t) for _, r, t in messages]


def test_random_logs_fold_like_a_plain_fold(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(60):
        events = []
        for seq in range(rng.randrange(1, 30)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            events.append((kind, rng.choice(["a", "b", "c", "d"]), rng.choice(["user", "assistant", None]), rng.choice(["x", "### y", "", None, "</turn>\\"])))
            rows.append((conv, seq, *events[-1]))
        want[conv] = plain_fold(events)
        assert chat.fold_events(events) == want[conv]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string").repartition(5)
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_chats(df).collect()}
    assert got == want


def test_the_log_of_turns_has_every_kind_and_gives_them_back(spark):
    long = "αβγ ### text </turn> \\" * 900
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("user", f"q{c}"), ("assistant", long[: c * 37]), ("user", None), ("assistant", "ok"), ("system", "")])]
    rows += [(7, 1, "assistant", "twice"), (7, 1, "assistant", "twice"), (None, 0, "user", "lost"), (50, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.conversation_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.groupBy("conv_id", "seq").count().where("count > 1").count() == 0
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    want = {}
    for r in sorted(rows, key=order):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_chats(log).collect()}
    assert got == want
    assert chat.conversation_log(df.limit(0)).count() == 0
