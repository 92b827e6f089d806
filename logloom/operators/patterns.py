"""Texts searched for any number of values at once.

A value is looked for by the hash of its first bytes, then by the hash of all of them, both in bitmaps of bounded size that
travel to the tasks; texts are hashed at every byte by prefix sums, a whole Arrow batch at a time. What passes is joined with the
values as text, so hashes decide nothing, and how long a text takes doesn't depend on how many values there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of each bitmap, at most: 2**26 are 8 MB. Where values are so many that they fill it, more is joined, and nothing is lost.
MAX_BITS = 1 << 26
#: Values of so many bytes or more begin with a gram of so many; shorter ones are grams themselves.
GRAMS = (8, 4, 3, 2, 1)
#: Bytes of texts that are hashed together; a longer text comes alone, whole.
CHUNK = 1 << 19
#: Bytes of values up to which they are broadcast; more are shuffled, whatever the planner takes their size for.
SMALL = 1 << 20

_ODD = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full((2, n), 1, np.uint64)
    steps[0, 1:], steps[1, 1:] = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
    up, down = np.cumprod(steps, axis=1, dtype=np.uint64)
    return up, down


class Sums:
    """Hashes of any run of bytes of ``data``, from prefix sums of powers."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(len(data), CHUNK).bit_length()
        up, self.down = _powers(n)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)) * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.total[start + length] - self.total[start]) * self.down[start] + np.uint64(length))


def gram_of(length: int) -> int:
    return next(g for g in GRAMS if length >= g)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and where each text begins and the last one ends."""
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), out=edges[1:])
    data = b"".join(texts.cast(pa.binary()).to_pylist())
    return np.frombuffer(data, np.uint8), edges


def _slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of values: (kind, slot) of their grams (0) and of themselves (1), each once a batch."""
    for batch in batches:
        data, edges = bytes_of(batch.column(0))
        sums, length, found = Sums(data), np.diff(edges), ([], [])
        for n in np.unique(length):
            start = edges[:-1][length == n]
            found[0].append(sums.of(start, gram_of(n)))
            found[1].append(sums.of(start, int(n)))
        for kind in (0, 1):
            slots = np.unique(np.concatenate(found[kind]) & np.uint64(bits - 1)).astype(np.int64) if len(length) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), kind, np.int32)), pa.array(slots)], ["kind", "slot"])


def _candidates(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray], lengths: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """Of texts (key, text): (part, keys) for each part that both bitmaps let through, with the rows of the chunk that hold it."""
    by_gram = {g: [n for n in lengths if gram_of(n) == g] for g in {gram_of(n) for n in lengths}}
    passes = lambda kind, h: (bitmaps[kind][(h & np.uint64(bits - 1)) >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1
    for batch in batches:
        texts = batch.column(1)
        whole = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(whole, whole[at] + CHUNK, side="right")) - 1)
            data, edges = bytes_of(texts.slice(at, to - at))
            sums, end = Sums(data), np.repeat(edges[1:], np.diff(edges))
            held: dict[bytes, set[int]] = {}
            for g, own in by_gram.items():
                start = np.arange(max(0, len(data) - g + 1))
                start = start[end[: len(start)] - start >= g]
                start = start[passes(0, sums.of(start, g))]
                for n in own:
                    fit = start[end[start] - start >= n]
                    fit = fit[passes(1, sums.of(fit, n))]
                    text = np.searchsorted(edges, fit, side="right") - 1
                    for t, s in zip(text.tolist(), fit.tolist(), strict=True):
                        held.setdefault(data[s : s + n].tobytes(), set()).add(at + t)
            keys = batch.column(0).take(pa.array([t for own in held.values() for t in own], pa.int64()))
            edges = np.concatenate([[0], np.cumsum([len(own) for own in held.values()])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.ListArray.from_arrays(pa.array(edges), keys)], ["part", "keys"])
            at = to


def matches(texts: DataFrame, values: DataFrame, key: str, text: str, value: str) -> DataFrame:
    """(key, value) for each row of ``texts`` whose text holds a value anywhere, whatever the case, each different value once a row.

    Null or empty values and null texts match nothing. Any number of values, of any length, overlapping ones and one that all
    texts hold included; values that differ in case alone each give a row. Lengths of values are as many as the plan is given.
    A value meets each chunk of texts that hold it in one row, so those of a frequent one are few in the join.
    """
    spark = texts.sparkSession
    sought = values.filter((F.col(value) != "") & F.col(value).isNotNull()).select(F.col(value).alias("value"), F.lower(value).cast("binary").alias("sought")).distinct()
    by_length = sought.groupBy(F.octet_length("sought").alias("n")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("value")).alias("size")).collect()  # a row for each length
    kind = texts.schema[key].dataType.simpleString()
    if not by_length:
        return spark.createDataFrame([], f"`{key}` {kind}, value {values.schema[value].dataType.simpleString()}")
    lengths = sorted(r["n"] for r in by_length)
    bits = min(MAX_BITS, 1 << max(16, (16 * sum(r["m"] for r in by_length) - 1).bit_length()))
    slots = sought.select("sought").mapInArrow(lambda b: _slots(b, bits), "kind int, slot long")
    cells = slots.groupBy("kind", F.expr("shiftright(slot, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")).toArrow()  # a row a word of the bitmaps
    words = [np.zeros(bits // 64, "<i8"), np.zeros(bits // 64, "<i8")]
    kinds, at, mask = (cells.column(c).to_numpy() for c in ("kind", "at", "mask"))
    for k in (0, 1):
        words[k][at[kinds == k]] = mask[kinds == k]
    sent = spark.sparkContext.broadcast([w.view(np.uint8) for w in words])
    low = texts.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    found = low.mapInArrow(lambda b: _candidates(b, sent.value, lengths, bits), f"part binary, keys array<{kind}>")
    small = sum(r["size"] for r in by_length) <= SMALL
    met = found.join(sought.hint("broadcast" if small else "merge"), F.col("part") == F.col("sought"))
    return met.select(F.explode("keys").alias(key), "value")
