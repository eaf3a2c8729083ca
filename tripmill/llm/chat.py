"""Chat formatting by folding an event log.

Events (conv_id, seq, kind, message, role, text) are dealt by conversation, sorted by
seq and folded into final messages:

- ``message`` appends a message (its id is `message`, or none);
- ``delta`` appends text to the message, opening it if it is unknown;
- ``edit`` replaces the message's text; an unknown message is opened;
- ``regenerate`` empties the message and drops all later ones; the deltas that follow
  write it anew. An unknown message is opened.

Then each conversation is rendered: ``### role: text</turn>`` and a line end for every
message. Backslashes, ``###`` and ``</turn>`` in texts, and ``:`` in roles, are escaped
by a backslash, so the output can be read back. The loss mask spans assistant texts.

Defined cases: null texts and roles are empty; events without a conversation id form one
conversation of their own; events of equal seq go messages first, then by kind,
message, role and text;
repeated events count each time; unknown kinds are errors. Other columns are not read.
An empty table gives no rows. A task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, tidy

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\\\|\\###|\\</turn>|\\:|[^\\:])*?): ((?:\\\\|\\###|\\</turn>|(?!</turn>)[^\\])*)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"### {escape(role, _ROLE_CONTROL)}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) messages of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def fold_events(events: list[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages of (kind, message, role, text) events in order."""
    messages: list[list] = []  # id, role, parts of the text
    last: dict = {}  # where each id was added last
    for kind, message, role, text in events:
        if kind == "message":
            last[message] = len(messages)
            messages.append([message, role or "", [text or ""]])
            continue
        if kind not in ("delta", "edit", "regenerate"):
            raise ValueError(f"unknown event kind {kind!r}")
        at = last.get(message)
        if at is None:
            last[message] = len(messages)
            messages.append([message, role or "", [text or ""]])
        elif kind == "delta":
            messages[at][2].append(text or "")
        else:
            messages[at][2] = [text or ""]
            if kind == "regenerate":
                del messages[at + 1 :]
                last = {m[0]: i for i, m in enumerate(messages)}
    return [(role, "".join(parts)) for _, role, parts in messages]


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss: array<struct<start, end>>) for every conversation."""
    spark = events.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            spans = [[{"start": a, "end": b} for a, b in s] for _, _, s in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(spans, loss)],
                names=["conv_id", "formatted", "loss"],
            )

        now, held, done = (None,), [], []
        for batch in batches:
            for conv, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != now and held:
                    done.append((now[0], *render(fold_events(held))))
                    held = []
                now = (conv,)
                held.append(event)
            if done:
                yield out(done)
                done = []
        if held:
            yield out([(now[0], *render(fold_events(held)))])

    return (
        events.select(F.col("conv_id").cast("long"), "seq", "kind", "message", "role", "text")
        .repartition(partitions(spark), "conv_id")
        .sortWithinPartitions("conv_id", "seq", F.col("kind") != "message", "kind", "message", "role", "text")
        .select("conv_id", "kind", "message", "role", "text")
        .mapInArrow(tidy(run), "conv_id long, formatted string, loss array<struct<start: long, end: long>>")
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events, one message each."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"),
        "role", "text",
    )


#: Deltas that a text is streamed in at most.
PIECES = 16


def conversation_log(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of how such a conversation comes about: by
    a hash of the row, a text is posted whole; streamed in deltas; posted as a draft and
    edited; or streamed as a draft with a follow-up, then regenerated and streamed anew.
    Folding the log gives the rows in the order of turn, role and text; null texts count as
    empty, repeated rows each have their own message."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("n"), F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(4)).alias("how"))
    own, none = F.col("n").cast("string"), F.lit(None).cast("string")
    event = lambda kind, text, message=own, role=F.col("role"): F.struct(F.lit(kind).alias("kind"), message.alias("message"), role.alias("role"), text.alias("text"))

    def streamed(text: Column, opens: bool) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.length(text) / PIECES)).cast("int")
        pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
        return F.transform(pieces, lambda i: event("delta", F.substring(text, i * size + 1, size), role=F.when((i == 0) & F.lit(opens), F.col("role"))))

    draft = F.concat(F.lit("draft: "), F.reverse(F.substring("text", 1, 200)))
    again = F.concat(streamed(draft, True), F.array(event("message", F.lit("and then?"), F.concat(own, F.lit("+")), F.lit("user")), event("regenerate", none)), streamed(F.col("text"), False))
    told = (
        F.when(F.col("how") == 0, F.array(event("message", F.col("text")))).when(F.col("how") == 1, streamed(F.col("text"), True))
        .when(F.col("how") == 2, F.array(event("message", draft), event("edit", F.col("text")))).otherwise(again)
    )
    # a row has 2 * PIECES + 2 events at most
    out = rows.select("conv_id", "n", F.posexplode(told).alias("k", "e"))
    return out.select("conv_id", (F.col("n") * 64 + F.col("k")).alias("seq"), "e.kind", "e.message", "e.role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says when it is read back: turns and the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((conv, len(turns), sha(all_turns), len(under), sha(under), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(tidy(run), schema)
