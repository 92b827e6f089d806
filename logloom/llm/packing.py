"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of tokens and earns credit at a rate: in proportion to its target, or where none is given to its share of
all tokens, so that all queues end together. Token i of a queue of rate r is due at (i + 1/2) / r; windows of ``size`` tokens take the tokens in the order in
which they fall due, ties by queue. What a queue is short of its share in one window (its deficit) is thus carried to the
next, and on across partitions, for due times depend on the totals alone. Any window's cuts are computed from the totals by
themselves: no window waits for another, nothing is shuffled, and only the last window is not full.

The scan that tokenizes also counts each queue's tokens within its partition; the partitions' sums give every document its
place in its queue.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import materialize

SIZE = 2048
#: The id that ends each document.
LAST = np.array([1], "<u4").tobytes()
#: Sources beyond so many share queues by hash, so that a window's cuts stay cheap.
MAX_QUEUES = 1024
#: A worker keeps the ids of about so many different words and parts of words at most.
MEMO_WORDS = 800_000
#: Texts are encoded together up to so many bytes; a longer one comes alone, whole.
CHUNK_BYTES = 1 << 22

_LETTER, _MARK = (np.array([chr(b) in of for b in range(256)]) for of in (string.ascii_letters, set(string.punctuation) - {"'"}))
_LETTERS = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")  # no apostrophe: it may begin a token with letters


def parted(texts: pa.Array) -> pa.Array:
    """Texts with a blank between each ASCII letter and a mark after it, but for an apostrophe: tokens apart."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1  # between two texts a blank goes to the first's end
    after = offsets - offsets[0] + np.searchsorted(at, offsets - offsets[0], side="right")
    data = np.insert(data, at, np.uint8(32))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(after), pa.py_buffer(data))


class Encoder(dict):
    """Ids of texts by a tokenizer that lower-cases and neither joins nor looks across blanks, but for strings of its own special
    tokens: a text that may hold one is encoded whole.

    The ids of words are kept for reuse, as little-endian unsigned 32-bit integers, in two generations: when the newer one is
    full it becomes the older one, and words that come again move back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}
        #: Which ids end a word, where the tokenizer marks them so.
        self.final = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            names = self.tokenizer.get_vocab()
            self.final = np.zeros(max(names.values()) + 1, bool)
            self.final[[i for name, i in names.items() if name.endswith(suffix)]] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            split = _LETTERS.fullmatch(word if word.islower() else word.lower())
            if not split:
                ids = self.encode(word)
            elif split[2]:  # a word of plain letters and a run of marks: tokens apart
                ids = self[split[1]] + self[split[2]]
            else:
                ids = self.encode(word) if split[1] == word else self[split[1]]
        self[word] = ids
        return ids

    def learn(self, words: list[str]) -> None:
        """Keeps the ids of the plain letters of ``words``: of many in one call, which takes about half the time of as many
        calls. Where the tokenizer doesn't tell ends of words, they are left to be encoded one by one."""
        if self.final is None:
            return
        new = [w.lower() for w in words if w not in self and w not in self.older]
        new = [w for w in dict.fromkeys(m[1] for m in map(_LETTERS.fullmatch, new) if m) if w not in self and w not in self.older]
        for a in range(0, len(new), 4096):
            some = new[a : a + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                data, ends = ids.tobytes(), (4 * ends).tolist()
                self.update((w, data[i:j]) for w, i, j in zip(some, [0, *ends], ends, strict=False))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, with the id that ends a document."""
        return [x for _, ids in self.batches(pa.array(texts, pa.string())) for x in ids.to_pylist()]

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Each text's number of tokens and its ids, with the id that ends a document, for consecutive texts together."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_BYTES, side="right")))
            yield self.together(texts.slice(a, b - a))
            a = b

    def together(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Each different word is looked up once, then the ids of all words are gathered at once."""
        if len(self) > MEMO_WORDS // 2:
            self.older = dict(self)
            self.clear()
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special, ignore_case=True).to_numpy(zero_copy_only=False)
        alone = [self.encode(text) for text in texts.filter(pa.array(whole)).to_pylist()]
        split = pc.ascii_split_whitespace(parted(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts))))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(different)
        known = [*map(self.__getitem__, different), LAST, *alone]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        # the words of each text, then what ends it; a text that is encoded whole is one empty word, which gives way to it
        last = len(words.dictionary)
        first = split.offsets.to_numpy().astype(np.int64)
        code = words.indices.to_numpy().astype(np.int64)
        code[first[:-1][whole] - first[0]] = last + 1 + np.arange(len(alone))
        code = np.insert(code, first[1:] - first[0], last)
        size = sizes[code]
        after = np.cumsum(size)
        at = np.arange(after[-1]) + np.repeat((np.cumsum(sizes) - sizes)[code] - (after - size), size)
        ends = after[first[1:] - first[0] + np.arange(len(texts))]
        offsets = np.concatenate([[0], ends]) * 4
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids[at])])
        return np.diff(offsets) // 4, data.cast(pa.binary())


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process: what it keeps serves all its tasks."""
    return Encoder(path)


class Mixture:
    """Queues of so many tokens each (``totals``) that go on at so many tokens a unit of time (``rates``) until they are empty."""

    def __init__(self, totals: np.ndarray, rates: np.ndarray | None = None):
        self.totals, self.rates = totals, totals.astype(float) if rates is None else rates.astype(float)
        self.total = int(totals.sum())
        ends = totals / self.rates
        self.times = np.concatenate([[0.0], np.unique(ends)])
        self.taken = np.minimum(self.rates * self.times[:, None], totals).sum(1)  # by all queues, at the times at which one ends
        # a queue's largest share among those that are left: at its own end
        by_end = np.argsort(ends, kind="stable")
        left = np.cumsum(self.rates[by_end][::-1])[::-1]
        share = np.empty(len(totals))
        share[by_end] = self.rates[by_end] / left[np.searchsorted(ends[by_end], ends[by_end], side="left")]
        self.share = np.minimum(share, 1.0)

    def time_of(self, tokens: np.ndarray) -> np.ndarray:
        """When so many tokens of all queues are due, about."""
        return np.interp(tokens, self.taken, self.times)

    def tokens_at(self, time: np.ndarray) -> np.ndarray:
        return np.interp(time, self.times, self.taken)


def cuts(windows: np.ndarray, mixture: Mixture, size: int = SIZE) -> np.ndarray:
    """How many tokens of each queue are in the first ``windows`` windows: a row for each value, a column for each queue."""
    totals, rates, n = mixture.totals, mixture.rates, len(mixture.totals)
    # the next tokens of each queue after those that are surely due: a queue of share p has about 2 n p of the next 2 n
    ahead = 4 + np.ceil(4 * n * mixture.share).astype(np.int64)
    queue, starts = np.repeat(np.arange(n), ahead), np.concatenate([[0], np.cumsum(ahead)[:-1]])
    nth = np.arange(len(queue)) - starts[queue]
    out = np.zeros((len(windows), n), np.int64)
    step = max(1, 500_000 // len(queue))
    for a in range(0, len(windows), step):
        want = np.minimum(windows[a : a + step].astype(np.int64) * size, mixture.total)
        sure = np.clip(np.floor(mixture.time_of(want)[:, None] * rates - 1.5).astype(np.int64), 0, totals)
        index = sure[:, queue] + nth
        due = np.where(index < totals[queue], (index + 0.5) / rates[queue], np.inf)
        taken = np.zeros(due.shape, np.int64)
        first = np.arange(len(queue)) < (want - sure.sum(1))[:, None]
        np.put_along_axis(taken, np.argsort(due, axis=1, kind="stable"), first, 1)
        out[a : a + step] = sure + np.add.reduceat(taken, starts, axis=1)
    return out


def pieces_of(start: np.ndarray, tokens: np.ndarray, queue: np.ndarray, mixture: Mixture, size: int = SIZE) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
    """For each document, the tokens start ... start + tokens - 1 of its queue: first token of each piece, length, window and
    offset in the window."""
    slack = len(mixture.totals) / size + 2
    place = lambda at: mixture.tokens_at(at / mixture.rates[queue]) / size
    lo = np.maximum(0, np.floor(place(start) - slack)).astype(np.int64)
    hi = np.minimum(-(-mixture.total // size), np.ceil(place(start + tokens) + slack)).astype(np.int64)
    windows = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])) if len(lo) else lo
    at = cuts(windows, mixture, size)
    before = np.cumsum(at, axis=1) - at
    for s, n, q, i, k in zip(start.tolist(), tokens.tolist(), queue.tolist(), np.searchsorted(windows, lo).tolist(), (hi - lo).tolist(), strict=True):
        own, ahead = at[i : i + k + 1, q], before[i : i + k + 1, q]
        a, b = np.maximum(own[:-1], s), np.minimum(own[1:], s + n)
        has = np.flatnonzero(b > a)
        a = a[has]
        yield (a - s).tolist(), (b[has] - a).tolist(), windows[i + has].tolist(), (ahead[has + 1] - ahead[has] + a - own[has]).tolist()


def rates_of(totals: dict[str, int], targets: dict[str, float] | None) -> np.ndarray | None:
    """Tokens a unit of time of each queue: by its target; queues without one share what targets leave by their tokens."""
    if not targets:
        return None
    if min(targets.values()) <= 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are shares above 0, of 1 at most together")
    rest = sum(n for q, n in totals.items() if q not in targets) or 1
    left = max(1 - sum(targets.values()), 1e-9)  # with nothing left for them, they come last
    return np.array([targets.get(q, left * n / rest) for q, n in totals.items()]) * sum(totals.values())


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, queue_col: str | None) -> DataFrame:
    """Rows (id, part, queue, at, n_tokens, ids): ``at`` counts the queue's tokens before it within the partition."""
    queue = F.coalesce(F.col(queue_col).cast("string"), F.lit("")) if queue_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sums = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            a = 0
            for sizes, ids in encode.batches(batch.column(2)):
                own, at = batch.slice(a, len(ids)), []
                a += len(ids)
                for q, n in zip(own.column(1).to_pylist(), sizes.tolist(), strict=True):
                    at.append(sums.get(q, 0))
                    sums[q] = at[-1] + n
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([part] * len(ids), pa.int32()), own.column(1), pa.array(at, pa.int64()), pa.array(sizes), ids], ["id", "part", "queue", "at", "n_tokens", "ids"])

    return rows.mapInArrow(scan, f"id {kind}, part int, queue string, at long, n_tokens long, ids binary")


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", size: int = SIZE, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: id, start, length, doc_tokens, sequence_id, offset, queue, piece_ids (little-endian uint32).

    A null or empty text is one token, the ending id. A null source is a queue of its own. Rows that repeat are packed as
    often. Sequences are numbered from 0; all but the last are full. An empty table gives an empty result. Other columns are
    ignored, whatever their names.

    ``targets`` names the shares of tokens that sources have in every window ("" is the null source); sources it doesn't name
    share the rest by their tokens. Without it each has its share of all tokens. No token is left out or repeated: where a source
    ends before the others, these go on in their proportions.
    """
    held = materialize(tokenized(docs, tokenizer, id_col, text_col, source_col), "tokens")
    sums = materialize(held.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n")), "sums")
    n_queues = sums.select("queue").distinct().count()
    kind = docs.schema[id_col].dataType.simpleString()
    some = F.concat(F.lit("queue "), F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES)).cast("string"))
    shared = F.col("queue") if n_queues <= MAX_QUEUES else F.when(F.col("queue").isin(*targets), F.col("queue")).otherwise(some) if targets else some
    # queues that share: their parts follow each other within a partition
    ahead = F.sum("n").over(Window.partitionBy("shared").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1))
    sums = materialize(sums.withColumn("shared", shared).select("part", "queue", "shared", "n", F.coalesce(ahead, F.lit(0)).alias("ahead")), "places")
    totals_of = dict(sorted((r["shared"], r["t"]) for r in sums.groupBy("shared").agg(F.sum("n").alias("t")).collect()))  # MAX_QUEUES at most
    mixture, number = Mixture(np.array(list(totals_of.values()), np.int64), rates_of(totals_of, targets)), {q: i for i, q in enumerate(totals_of)}
    places = sums.select("part", "queue", "shared", "ahead")
    if sums.count() <= 1_000_000:  # partitions x queues; otherwise a shuffle join
        places = F.broadcast(places)
    rows = held.join(places, ["part", "queue"]).select("id", (F.col("ahead") + F.col("at")).alias("at"), "shared", "n_tokens", "ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "queue", "piece_ids"]
        for batch in batches:
            start, tokens = (batch.column(i).to_numpy() for i in (1, 3))
            queues = np.array([number[q] for q in batch.column(2).to_pylist()], np.int64)
            row, out, data = [], [[], [], [], []], []
            for i, (x, found) in enumerate(zip(batch.column(4).to_pylist(), pieces_of(start, tokens, queues, mixture, size), strict=True)):
                row += [i] * len(found[0])
                for to, values in zip(out, found, strict=True):
                    to += values
                data += [x[4 * s : 4 * (s + m)] for s, m in zip(found[0], found[1], strict=True)]
            take = pa.array(row, pa.int64())
            start, length, window, offset = (pa.array(x, pa.int64()) for x in out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), start, length, batch.column(3).take(take), window, offset, batch.column(2).take(take), pa.array(data, pa.binary())], names)

    return rows.mapInArrow(scan, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, queue string, piece_ids binary").withColumnRenamed("id", id_col)


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")
