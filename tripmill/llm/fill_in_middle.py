"""Fill-in-middle transformation by block rotation in place.

A text is cut into units (lines by default). Two cuts and the form come from the SHA-256
of a seed and the document id, so a document is cut alike on every run and machine. The
text is laid out once as `<P>prefix<M>middle<S>suffix` in a bytearray; either form is then
one exchange of two neighbouring segments, done by three reversals. Restoring runs the
exchange backwards and takes the sentinels out.

    psm  <P>prefix<S>suffix<M>middle      spm  <S>suffix<P>prefix<M>middle

Defined cases: a null text counts as the empty text; an empty text, and one that contains
a sentinel, stays as it is (form plain, no cuts). A null id is digested as no digits.
Repeated rows are treated row by row, an empty table gives no rows, other columns are not
read. Lengths are in code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes exchanged at once in a reversal.
STRIP = 1 << 16


def _reverse(v: np.ndarray, a: int, b: int) -> None:
    """Reverse v[a:b] in place, strip by strip from both ends."""
    while b - a > 1:
        k = min((b - a) // 2, STRIP)
        left = v[a : a + k].copy()
        v[a : a + k] = v[b - k : b][::-1]
        v[b - k : b] = left[::-1]
        a, b = a + k, b - k


def rotate(buffer: bytearray, a: int, b: int, c: int) -> None:
    """Exchange the neighbouring segments buffer[a:b] and buffer[b:c] in place."""
    v = np.frombuffer(buffer, np.uint8)
    _reverse(v, a, b)
    _reverse(v, b, c)
    _reverse(v, a, c)


def code_points(raw: bytes | bytearray | memoryview) -> int:
    """Code points of UTF-8 bytes: those that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def line_ends(raw: bytes) -> np.ndarray:
    """End offsets of the lines of raw; the last may lack its line break."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.append(ends, len(raw)) if raw and raw[-1] != 10 else ends


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit integers of `seed:doc_id`."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(raw: bytes, h: list[int], rate: int, spm_rate: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix and middle length, output) of one text."""
    ends = line_ends(raw)
    n = len(ends)
    if not raw or any(m in raw for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, raw
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m = (int(ends[k - 1]) if k else 0 for k in (first, second))
    pre, suf, mid = marks
    out = bytearray(pre + raw[:p])
    a = len(out)
    out += mid
    out += raw[p:m]
    b = len(out)
    out += suf
    out += raw[m:]
    if h[3] % 100 < spm_rate:
        form = "spm"
        rotate(out, 0, b, len(out))
    else:
        form = "psm"
        rotate(out, a, b, len(out))
    return n, form, code_points(raw[:p]), code_points(raw[p:m]), bytes(out)


def invert(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of an output: the exchange undone, then the sentinels removed."""
    if form == "plain":
        return output
    pre, suf, mid = marks
    out = bytearray(output)
    s, m, end = out.index(suf), out.index(mid), len(out)
    if form == "spm":  # suffix | prefix, middle
        p = out.index(pre)
        rotate(out, 0, p, end)
    else:  # prefix | suffix | middle
        rotate(out, s, m, end)
    s, m = out.index(suf), out.index(mid)
    del out[s : s + len(suf)]
    del out[m : m + len(mid)]
    del out[: len(pre)]
    return bytes(out)


def fill_in_middle(
    docs: DataFrame, seed: str = "7", rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of docs.

    rate: hundredths of the texts that are cut; spm_rate: hundredths of these in the form
    spm. One narrow pass; a task holds a batch of texts.
    """
    small_batches(docs.sparkSession)
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for doc_id, text in zip(ids, texts):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append(transform(raw, draws(seed, doc_id), rate, spm_rate, marks))
            n, form, prefix, middle, out = ([r[k] for r in rows] for k in range(5))
            arrays = [
                batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(cut: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """cut (rows of `fill_in_middle`) with the column restored, the exact text."""
    small_batches(cut.sparkSession)
    marks = tuple(s.encode() for s in sentinels)
    names = [c for c in cut.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, out = batch.column(names.index("form")).to_pylist(), batch.column(names.index("output"))
            texts = [invert(o.as_buffer().to_pybytes(), f, marks) for f, o in zip(form, out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "restored"])

    given = cut.select(*names)
    return given.mapInArrow(tidy(run), T.StructType([*given.schema, T.StructField("restored", T.StringType())]))
