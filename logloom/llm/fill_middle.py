"""Fill-in-middle transformation by in-place block rotation.

A text's token ends are scanned once, two hashed cuts make prefix, middle and suffix, and sentinels go before each of them in
one bytearray. Segments then change places by three reversals (each of the two, then both together), which takes no second
copy of the text; the same rotations in reverse order restore it exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from logloom.llm.words import Alphabet, chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A reversal exchanges so many bytes of either end at a time.
STEP = 1 << 16


def reverse(data: np.ndarray, a: int, b: int) -> None:
    """data[a:b] backwards, in place."""
    while b - a > 1:
        n = min(STEP, (b - a) // 2)
        head = data[a : a + n][::-1].copy()
        data[a : a + n] = data[b - n : b][::-1]
        data[b - n : b] = head
        a, b = a + n, b - n


def rotate(data: np.ndarray, a: int, b: int, c: int) -> None:
    """data[a:b] and data[b:c] change places, each kept in its order."""
    reverse(data, a, b)
    reverse(data, b, c)
    reverse(data, a, c)


def rearranged(text: bytes, prefix: int, middle: int, form: str) -> bytearray:
    """The text with sentinels, its segments in the order of ``form``; they end at the bytes ``prefix`` and ``middle``."""
    out = bytearray(text)
    if form == "plain":
        return out
    for at, mark in ((middle, SUFFIX), (prefix, MIDDLE), (0, PREFIX)):
        out[at:at] = mark
    p, m, end = prefix + len(PREFIX), middle + len(PREFIX) + len(MIDDLE), len(out)
    data = np.frombuffer(out, np.uint8)
    rotate(data, p, m, end)  # prefix, suffix, middle
    if form == "spm":
        rotate(data, 0, p, p + end - m)  # suffix, prefix, middle
    del data
    return out


def restored(output: bytes, form: str) -> bytearray:
    """The text that ``rearranged`` was given, from what it made and the form alone: rotations inverted, sentinels taken out."""
    out = bytearray(output)
    if form == "plain":
        return out
    end, m = len(out), out.index(MIDDLE)
    data = np.frombuffer(out, np.uint8)
    if form == "spm":
        s = out.index(PREFIX)
        rotate(data, 0, s, m)
        p = m - s
    else:
        p = out.index(SUFFIX)
    rotate(data, p, m, end)  # prefix, middle, suffix
    del data
    m = p + end - m
    for at, mark in ((m, SUFFIX), (p, MIDDLE), (0, PREFIX)):
        del out[at : at + len(mark)]
    return out


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; ``rate`` of 100 are transformed, ``spm_rate`` of those to
    suffix, prefix, middle, the others to prefix, suffix, middle.

    A token is a word with the white space before it, or white space that ends the text; cuts and forms follow from the hash of
    ``seed`` and id, so rows that repeat come out alike, and a null id counts as the empty string. A null text is empty; empty
    texts, and those that hold a sentinel, stay plain, with null lengths. Texts of any length are cut and rotated whole. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet("space", fold=False)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, words in chunks(batch.column(1), alphabet):
                out = [[], [], [], [], []]
                edges = np.cumsum([0, *pc.binary_length(batch.column(1).slice(a, b - a)).fill_null(0).to_pylist()])
                for i in range(b - a):
                    text, ends = words.data[edges[i] : edges[i + 1]], words.end[words.of(i)] - edges[i]
                    if len(text) and not (len(ends) and ends[-1] == len(text)):
                        ends = np.append(ends, len(text))
                    n, raw = len(ends), text.tobytes()
                    hexed = hashlib.sha256(f"{seed}:{'' if ids[a + i] is None else ids[a + i]}".encode()).hexdigest()
                    h = [int(hexed[j : j + 8], 16) for j in range(0, 32, 8)]
                    plain = not raw or h[2] % 100 >= rate or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE))
                    form = "plain" if plain else "spm" if h[3] % 100 < spm_rate else "psm"
                    p, m = (int(ends[u - 1]) if u else 0 for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    chars = (None, None) if plain else (code_points(text[:p]), code_points(text[p:m]))
                    for to, value in zip(out, (n, form, *chars, bytes(rearranged(raw, p, m, form))), strict=True):
                        to.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """``rows`` with the column ``to``: the text from which the output was made. A null output or form gives null."""
    schema = StructType([*rows.schema, StructField(to, StringType())])
    names = [*rows.columns, to]
    at = rows.columns.index(output_col), rows.columns.index(form_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                own = batch.slice(a, 64)
                pairs = zip(*(own.column(i).to_pylist() for i in at), strict=True)
                texts = [None if o is None or f is None else bytes(restored(o.encode(), f)) for o, f in pairs]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(scan, schema)
