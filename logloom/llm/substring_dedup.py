"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash among its runs of ``M`` words.
Consecutive windows that share one occurrence of a minimiser (a super-k-mer) travel as one packed string, their words, to
the bucket of that minimiser; equal windows have equal minimisers, so they meet in one bucket.

1. A scan counts minimisers in the slots of a bounded filter; a super-k-mer whose slot is hit once repeats nowhere.
2. A second scan packs only the others. Equal packed strings are counted first: all but their first occurrence are repeats.
3. Where a bucket holds several different strings, the windows of their first occurrences are unpacked and sorted.
4. Covered words are removed; texts without any stay where they are, the others meet their spans by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import attach_groups, bloom_probe, bloom_words, filter_bits, materialize
from logloom.llm.words import Alphabet, Words, chunks, grams, inside_text, window_min

WINDOW, M = 20, 5
#: Slots of the filter that is broadcast: 32 MB at most. With more super-k-mers than slots it lets more through, losing none.
MAX_SLOTS = 1 << 28
#: Slots of the filter are gathered in pieces of so many.
PIECE = 1 << 20

_PLACE = np.uint64((1 << 24) - 1)


def super_kmers(words: Words, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer."""
    windows = inside_text(words, window)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    gram = grams(words.hash, m)
    place = np.arange(len(gram), dtype=np.uint64)
    # the leftmost least one of each window, by the hash's upper bits; a text of over 2 ** 24 words begins new ones there
    least = window_min((gram & ~_PLACE) | (place & _PLACE), window - m + 1)[: len(windows)]
    at = np.flatnonzero(windows)
    here = (at + ((least[at] - at.astype(np.uint64)) & _PLACE).astype(np.int64)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (here[1:] != here[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), gram[here[first]]


def _filter(rows: DataFrame, spark: SparkSession, slots: int, window: int, m: int) -> np.ndarray:
    """Bits of the slots that at least two super-k-mers hit."""
    alphabet = Alphabet("space", fold=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in chunks(batch.column(2), alphabet):
                slot, n = np.unique(super_kmers(words, window, m)[2] & np.uint64(slots - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["slot", "n"])

    def gather(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        bits = np.zeros(PIECE, bool)
        bits[part["slot"].to_numpy() & (PIECE - 1)] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    often = rows.mapInArrow(count, "slot long, n int").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").select("slot")
    pieces = often.groupBy(F.expr(f"slot div {PIECE}").alias("piece")).applyInArrow(gather, "piece long, bits binary")
    out = np.zeros((max(1, slots // PIECE), PIECE // 8), np.uint8)
    for row in pieces.toLocalIterator():  # MAX_SLOTS / 8 bytes in all at most
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def own_hash(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows of the same id apart: a hash of the text, or 0 for all where no id repeats."""
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64(text_col)


def _own_key(*columns: str) -> Column:
    """A key of a row's own, as long as the hashes of strings, for rows of hot strings."""
    return F.unhex(F.md5(F.concat_ws(" ", F.lit("row"), *(F.col(c).cast("string") for c in columns))))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = M) -> DataFrame:
    """Rows (id, h, start, stop): words start ... stop - 1 of the document with this id and own_hash h are repeats."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), own_hash(docs, id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    slots = max(PIECE, filter_bits(chars // 32, 8, MAX_SLOTS))
    seen = spark.sparkContext.broadcast(_filter(rows, spark, slots, window, m))
    alphabet = Alphabet("space", fold=False)
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, words in chunks(batch.column(2), alphabet):
                first, n, minimiser = super_kmers(words, window, m)
                slot = (minimiser & np.uint64(slots - 1)).astype(np.int64)
                kept = np.flatnonzero((seen.value[slot >> 3] >> (slot & 7)) & 1)
                first, n, minimiser = first[kept], n[kept], minimiser[kept]
                text = np.searchsorted(words.first, first, side="right") - 1
                body = words.data.tobytes()
                packed = [b" ".join(body[a:b].split()) for a, b in zip(words.start[first].tolist(), words.end[first + n + window - 2].tolist(), strict=True)]
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in packed]
                take = pa.array(text + row)
                start = first - words.first[text]
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(minimiser.view(np.int64)), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "start", "n", "minimiser", "key", "packed"])

    found = materialize(rows.mapInArrow(pack, f"id {kind}, h long, start long, n long, minimiser long, key binary, packed string"), "super-k-mers")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"), F.col("start"))
    strings = materialize(found.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), F.min("minimiser").alias("minimiser"), F.min("n").alias("n")), "strings")
    # all but the first of equal strings
    repeated = strings.filter("times > 1").select("key", "first", "n", "times")
    later = attach_groups(found.select("id", "h", "start", "key"), repeated, "key", "times", found.count(), _own_key("id", "h", "start")).filter(place != F.col("first"))
    later = later.select("id", "h", "start", (F.col("start") + F.col("n") + (window - 1)).alias("stop"))
    # windows of the first ones, where different strings have the same minimiser
    shared = strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    several = attach_groups(strings.select("key", "first", "minimiser"), shared, "minimiser", "k", strings.count(), F.xxhash64("key"))
    several = materialize(several.filter("k is not null").select("key", "first"), "several")
    bits = filter_bits(several.count())
    firsts = bloom_words(several.select(F.xxhash64("key", "first.id", "first.h", "first.start").alias("at")), "at", bits)
    near = bloom_probe(found, firsts, F.xxhash64("key", "id", "h", "start"), bits, "maybe").filter("maybe")
    unpacked = near.join(several, "key").filter(place == F.col("first")).dropDuplicates(["key"]).select("id", "h", "start", "packed")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part, row, at, out = batch.slice(a, 1024), [], [], []
                for i, text in enumerate(part.column(3).to_pylist()):
                    words = text.encode().split(b" ")
                    n = len(words) - window + 1
                    row += [i] * n
                    at += range(n)
                    out += [hashlib.blake2b(b" ".join(words[j : j + window]), digest_size=16).digest() for j in range(n)]
                take = pa.array(row, pa.int64())
                start = pc.add(part.column(2).take(take), pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), start, pa.array(out, pa.binary())], ["id", "h", "start", "window"])

    windows = unpacked.mapInArrow(unpack, f"id {kind}, h long, start long, window binary")
    windows = materialize(windows, "windows")
    firsts = materialize(windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1"), "firsts")
    other = attach_groups(windows, firsts, "window", "times", windows.count(), _own_key("id", "h", "start")).filter(place != F.col("first")).select("id", "h", "start", (F.col("start") + window).alias("stop"))
    return later.unionByName(other)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = M) -> DataFrame:
    """For each document: its id, n_words, n_removed, kept_text (the words left, joined by one space).

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window over it has the same words
    as one that starts earlier: in a document with a smaller id, or in the same one before it. Windows are judged on the
    input. A null or empty text, or one of fewer words than a window, loses nothing. Documents without an id come last. Rows
    with the same id and text are one document and get the same result each; with the same id and other texts they come in
    the order of a hash of the text. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spans = repeated_spans(docs, id_col, text_col, window, m)
    own = F.xxhash64(F.col("id").isNull(), "id", "h")
    spans = materialize(spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).select(own.alias("own"), F.col("id").alias("id2"), F.col("h").alias("h2"), "spans"), "spans")
    bits = filter_bits(spans.count())
    rows = docs.select(F.col(id_col).alias("id"), own_hash(docs, id_col, text_col).alias("h"), F.col(text_col).alias("text")).withColumn("own0", own)
    rows = bloom_probe(rows, bloom_words(spans, "own", bits), F.col("own0"), bits, "maybe")
    hit = rows.filter("maybe").join(spans, (F.col("own0") == F.col("own")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    both = rows.filter("not maybe").select("id", "text", none.alias("spans")).unionByName(hit.select("id", "text", "spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, all_spans = part.column(1).to_pylist(), part.column(2).to_pylist()
                kept, sizes = [], []
                for text, own in zip(texts, all_spans, strict=True):
                    words = (text or "").encode().split()
                    sizes.append(len(words))
                    if own:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [s["start"] for s in own], 1)
                        np.add.at(edge, [s["stop"] for s in own], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    kept.append((len(words), b" ".join(words)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([n - k for n, (k, _) in zip(sizes, kept, strict=True)], pa.int64()), pa.array([x for _, x in kept], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return both.mapInArrow(remove, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
