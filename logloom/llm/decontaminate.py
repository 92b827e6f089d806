"""Benchmark decontamination by winnowing.

Of every ``W`` consecutive grams of ``K`` words the least hash is kept as a fingerprint, so any span of K + W - 1 = 10 words
that a document shares with an item has a fingerprint in common. Document and item fingerprints are joined and each hit is
extended word by word to the longest common span; spans of at least ten words count. Items of fewer words are matched as
wholes by a gram of their own length.

While the benchmark is small (its size is measured), its index is broadcast and the join runs inside the scan of the
documents. Beyond ``broadcast_chars`` the fingerprints are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialize
from logloom.llm.words import Alphabet, Words, chunks, grams, inside_text, mix, window_min

SPAN, K = 10, 6
W = SPAN - K + 1
#: Up to so many characters of benchmark texts the index is broadcast (about 12 bytes a character with fingerprints).
BROADCAST_CHARS = 32_000_000

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all fingerprints."""
    gram = np.where(inside_text(words, K), grams(words.hash, K), NONE)
    if not len(gram):
        return np.zeros(0, np.int64), gram
    edge = np.full(W - 1, NONE, np.uint64)
    least = window_min(np.concatenate([edge, gram, edge]), W)  # of the windows that end at each gram, and so on
    chosen = gram == least[: len(gram)]
    for i in range(1, W):
        chosen |= gram == least[i : i + len(gram)]
    at = np.flatnonzero(chosen & (gram != NONE))
    return at, gram[at]


def whole(words: Words, length: int) -> np.ndarray:
    """Hash of ``length`` words from each word on, apart from the fingerprints; where they don't lie in one text, NONE."""
    return np.where(inside_text(words, length), mix(grams(words.hash, length) + np.uint64(length)), NONE)


@dataclass
class Index:
    """Items with their words, and places of fingerprints (of items of ten words or more) or of wholes, by length."""

    names: list[str]
    words: list[np.ndarray]
    keys: dict[int, np.ndarray]
    places: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, names: list[str], texts: list[str | None], alphabet: Alphabet) -> Index:
        own: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for a, b, words in chunks(pa.array(texts, pa.string()), alphabet):
            text = words.text_of_word()
            size = np.diff(words.first)
            at, fp = winnow(words)
            full = size[text[at]] >= SPAN
            found.setdefault(0, []).append((fp[full], text[at][full] + a, (at - words.first[text[at]])[full]))
            for n in {int(x) for x in size if 0 < x < SPAN}:
                items = np.flatnonzero(size == n)
                found.setdefault(n, []).append((whole(words, n)[words.first[items]], items + a, np.zeros(len(items), np.int64)))
            own += [words.hash[words.of(i)].copy() for i in range(b - a)]
        keys, places = {}, {}
        for n, parts in found.items():
            key, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            if len(order):
                keys[n], places[n] = key[order], (item[order], place[order])
        return cls(names, own, keys, places)

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(document word, item, item word, length or 0 for a fingerprint) of all matching hashes."""
        for n, key in self.keys.items():
            at, fp = winnow(words) if n == 0 else (np.arange(len(words.hash) - n + 1), whole(words, n))
            lo = np.searchsorted(key, fp)
            near = np.minimum(lo, len(key) - 1)
            for i in np.flatnonzero((key[near] == fp) & (fp != NONE)):
                item, place = self.places[n]
                for j in range(lo[i], int(np.searchsorted(key, fp[i], side="right"))):
                    yield int(at[i]), int(item[j]), int(place[j]), n


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def extended(words: Words, index: Index) -> tuple[np.ndarray, list[set[int]]]:
    """Which words are hit, and each text's items."""
    hit, items = np.zeros(len(words.hash) + 1, np.int64), [set() for _ in range(len(words.first) - 1)]
    done: dict[tuple[int, int], int] = {}
    for at, item, place, n in index.hits(words):
        text = int(np.searchsorted(words.first, at, side="right")) - 1
        own, theirs = words.hash[words.of(text)], index.words[item]
        here = at - int(words.first[text])
        if n:
            start, stop = here, here + n
            if _run(own[start:stop], theirs) < n:
                continue
        else:
            if done.get((text, item, here - place), -1) > here:
                continue
            back = _run(own[:here][::-1], theirs[:place][::-1])
            start, stop = here - back, here + _run(own[here:], theirs[place:])
            done[text, item, here - place] = stop
            if stop - start < SPAN:
                continue
        items[text].add(item)
        hit[words.first[text] + start] += 1
        hit[words.first[text] + stop] -= 1
    return np.cumsum(hit[:-1]) > 0, items


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _row_key(id_col: str, text_col: str) -> Column:
    """The same for rows of the same id, null or not, and the same text: what a row holds, hits and is depends on no more."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(" "), c.cast("string")), F.lit("none"))
    return F.md5(F.concat(part(F.col(id_col)), F.lit(" "), part(F.col(text_col))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """For each document: its id, n_words, n_hit, n_items, items (their ids as strings, sorted), items_sha256, contaminated.

    Texts without words, empty or null, hit nothing and are hit by nothing. Items with equal texts all count. An item without
    an id is named "null". Rows that repeat are reported as often. Empty tables give empty or clean results. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("item_text"))
    out = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    size = items.agg(F.sum(F.length("item_text") + 20)).first()[0] or 0
    alphabet = Alphabet("alnum", fold=True)

    def result(ids: pa.Array, found: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
        n_words, n_hit, names = zip(*found, strict=True) if found else ((), (), ())
        columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(map(sorted, names), pa.list_(pa.string())), pa.array(map(_digest, names), pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    def scanned(words: Words, index: Index) -> list[tuple[int, int, list[str]]]:
        hit, of = extended(words, index)
        total = np.concatenate([[0], np.cumsum(hit)])
        return [(int(b - a), int(total[b] - total[a]), [index.names[x] for x in i]) for a, b, i in zip(words.first[:-1], words.first[1:], of, strict=True)]

    if size <= broadcast_chars:
        held = items.collect()
        index = spark.sparkContext.broadcast(Index.of([r["item"] for r in held], [r["item_text"] for r in held], alphabet))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [x for _, _, words in chunks(batch.column(1), alphabet) for x in scanned(words, index.value)]
                yield result(batch.column(0), found)

        return rows.mapInArrow(scan, out)

    lengths = [r[0] for r in items.mapInArrow(_short_lengths, "n int").distinct().collect()]  # nine at most

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in chunks(batch.column(1), alphabet):
                text = words.text_of_word()
                at, fp = winnow(words)
                parts = [(text[at], fp)] + [(text[: max(0, len(text) - n + 1)], whole(words, n)) for n in lengths]
                row, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
                row, fp = row[fp != NONE], fp[fp != NONE]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(fp.view(np.int64))], [id_col, "fp"])

    keyed = rows.withColumn("__row", _row_key(id_col, "__text"))
    doc_prints = keyed.select(F.col("__row").alias(id_col), "__text").mapInArrow(prints, f"`{id_col}` string, fp long").withColumnRenamed(id_col, "__row")
    numbered = materialize(items.withColumn("nr", F.monotonically_increasing_id()), "items")
    item_prints = numbered.select(F.col("nr").alias(id_col), F.col("item_text").alias("__text")).mapInArrow(prints, f"`{id_col}` long, fp long").select(F.col(id_col).alias("nr"), "fp").distinct()
    pairs = doc_prints.join(item_prints, "fp").select("__row", "nr").distinct()
    near = pairs.join(numbered, "nr").groupBy("__row").agg(F.collect_list("item").alias("__names"), F.collect_list(F.coalesce("item_text", F.lit(""))).alias("__texts"))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, words in chunks(batch.column(1), alphabet):
                for i in range(a, b):
                    own = Words(words.data, words.start, words.end, words.hash[words.of(i - a)], np.array([0, words.first[i - a + 1] - words.first[i - a]]))
                    found += scanned(own, Index.of(batch.column(2)[i].as_py() or [], batch.column(3)[i].as_py() or [], alphabet))
            yield result(batch.column(0), found)

    return keyed.join(near, "__row", "left").select(id_col, "__text", "__names", "__texts").mapInArrow(one_by_one, out)


def _short_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alphabet = Alphabet("alnum", fold=True)
    for batch in batches:
        sizes = {int(n) for _, _, words in chunks(batch.column(1), alphabet) for n in np.diff(words.first) if 0 < n < SPAN}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int32())], ["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text shares no window with the benchmark, with all their columns."""
    from logloom.llm.common import keep_or_drop

    keyed = docs.withColumn("__key", _row_key(id_col, text_col))
    verdicts = materialize(contamination(keyed, benchmark, "__key", text_col).filter("contaminated").select("__key"), "contaminated")
    return keep_or_drop(keyed, verdicts, "__key", verdicts.count(), keep=False).select(*docs.columns)
