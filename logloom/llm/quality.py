"""Quality classifier by co-training (Blum and Mitchell, 1998).

Two views of a document are judged apart: its text (hashed words and pairs of words, and what it is made of) and its metadata
(language, source, stated length, and where its web page is known the page's address, title and markup). Each view starts from labelled documents; in every round the documents that one view is sure
of become pseudo-labelled for the other, and stay so: the first round that is sure of a document decides. Each view learns by
counts of its features in good and bad documents, summed over all of them by Spark. Both are calibrated on labelled documents
that were held out, and combined there.

Labelled documents are a sample of bounded size (MAX_LABELLED); pseudo-labelled ones aren't: all that a view is sure of count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import discard, materialize
from logloom.llm.page_view import MARKS, with_marks
from logloom.llm.toxic import fit_toxic
from logloom.llm.words import Alphabet, Words, chunks, grams, inside_text, mix

#: Labelled rows of each class at most: those with the least hashes of their ids.
MAX_LABELLED = 20_000
ROUNDS = 2
#: A view is sure of what it gives less than this, or more than one less this, of a chance of being good.
SURE = 0.02
#: Hashed features of a text, and of metadata: the document's own come first, those of its page behind them.
WORDS, OWN = 1 << 15, 1 << 10
PAGE = OWN + MARKS
#: Counts that each feature starts with in both classes.
PRIOR = 1.0

#: Which bytes are of a kind: other marks, upper case, digits, and marks that part.
_KINDS = [
    np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ",-." for b in range(256)], np.int32),
    np.array([0x41 <= b <= 0x5A for b in range(256)], np.int32),
    np.array([0x30 <= b <= 0x39 for b in range(256)], np.int32),
    np.array([b in b"|,." for b in range(256)], np.int32),
]


@dataclass
class Batch:
    """Features of consecutive documents: word buckets with the document of each, shapes, metadata buckets with the document
    of each."""

    bucket: np.ndarray
    doc: np.ndarray
    shape: np.ndarray
    page: np.ndarray
    page_doc: np.ndarray

    def __len__(self) -> int:
        return len(self.shape)


def _shape(words: Words, offsets: np.ndarray) -> np.ndarray:
    """What each text is made of: shares of kinds of characters, of different words, lengths. All 0 for an empty text."""
    n = np.diff(words.first)
    size = np.maximum(np.diff(offsets), 1)
    shares = []
    for kind in _KINDS:  # one at a time, so that little memory is held
        ends = np.concatenate([[0], np.cumsum(kind[words.data])])
        shares.append((ends[offsets[1:]] - ends[offsets[:-1]]) / size)
    different = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)], float) / np.maximum(n, 1)
    return np.stack([*shares, different, different * np.log1p(n), size / np.maximum(n, 1) / 10 * (n > 0), np.log1p(n)], 1)


def _page(lang: list, source: list, chars: list, marks: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of language, source, both, stated length by powers of two, and of the page's marks; the document of each. Nulls
    are values of their own, but for marks: a document without a page has none."""
    size = [None if c is None else int(np.log2(max(c, 0) + 1)) for c in chars]
    named = [[f"l {a}", f"s {b}", f"ls {a} {b}", f"n {c}"] for a, b, c in zip(lang, source, size, strict=True)]
    hashed = np.array([[int.from_bytes(x.encode()[-8:], "little") ^ len(x) << 40 ^ sum(x.encode()) << 48 for x in row] for row in named], np.uint64).reshape(-1, 4)
    own = (mix(hashed) % np.uint64(OWN)).astype(np.int64)
    sizes = [len(m or ()) for m in marks]
    more = np.array([x for m in marks for x in m or ()], np.int64) + OWN
    docs = np.arange(len(marks))
    return np.concatenate([own.ravel(), more]), np.concatenate([np.repeat(docs, own.shape[1]), np.repeat(docs, sizes)])


def _batches(batch: pa.RecordBatch, text: str, lang: str, source: str, chars: str, marks: str | None) -> Iterator[tuple[int, Batch]]:
    """(first row, features) of parts of an Arrow batch."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    meta = [column(c).to_pylist() if c else [None] * batch.num_rows for c in (lang, source, chars, marks)]
    for a, b, words in chunks(column(text), Alphabet("space", fold=True)):
        of_word = words.text_of_word()
        pairs = inside_text(words, 2)
        both = np.concatenate([words.hash, grams(words.hash, 2)[pairs]])
        doc = np.concatenate([of_word, of_word[: len(pairs)][pairs]])
        lengths = pc.fill_null(pc.binary_length(column(text).slice(a, b - a)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        shape = _shape(words, np.concatenate([[0], np.cumsum(lengths)]))
        yield a, Batch((mix(both) % np.uint64(WORDS)).astype(np.int64), doc, shape, *_page(*(m[a:b] for m in meta)))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Logistic:
        """By Newton steps, on standardised features."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return cls(w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum()))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.bias, -20, 20)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of each feature from its counts (bad, good)."""
    share = (counts + PRIOR) / (counts + PRIOR).sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


@dataclass
class Views:
    """Both views: log-odds of words and of metadata, and the logits that calibrate them."""

    words: np.ndarray
    page: np.ndarray
    text_fit: Logistic | None = None
    page_fit: Logistic | None = None

    def features(self, x: Batch) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(x.doc, self.words[x.bucket], len(x))
        mean = total / np.maximum(np.bincount(x.doc, minlength=len(x)), 1)
        own = x.page < OWN
        of = [np.bincount(x.page_doc[which], self.page[x.page[which]], len(x)) for which in (own, ~own)]
        return np.hstack([mean[:, None], x.shape]), np.stack([*of, np.bincount(x.page_doc[~own], minlength=len(x)) > 0], 1).astype(float)

    def logits(self, x: Batch) -> tuple[np.ndarray, np.ndarray]:
        t, p = self.features(x)
        return self.text_fit.logit(t), self.page_fit.logit(p)


@dataclass
class QualityModel:
    """Both views and how their logits combine. Without views all documents score ``prior``."""

    views: Views | None
    mix: Logistic | None
    prior: float = 1.0

    def scored(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", marks_col: str | None = None) -> DataFrame:
        """``docs`` with p_text, p_page and score: chances that the document is good."""
        if self.views is None:
            return docs.select("*", *(F.lit(self.prior).alias(c) for c in ("p_text", "p_page", "score")))
        model = docs.sparkSession.sparkContext.broadcast((self.views, self.mix))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, mixed = model.value
            for batch in batches:
                for a, x in _batches(batch, text_col, lang_col, source_col, chars_col, marks_col):
                    t, p = views.logits(x)
                    out = (_chance(t), _chance(p), _chance(mixed.logit(np.stack([t, p], 1))))
                    part = batch.slice(a, len(x))
                    yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, out)], [*part.schema.names, "p_text", "p_page", "score"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(score, f"{kinds}, p_text double, p_page double, score double")


class _Fit:
    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str, label_col: str, marks_col: str | None):
        given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        given = given.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
        self.own = {r["id"]: (r["y"], r["held"]) for y in (0, 1) for r in given.filter(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(MAX_LABELLED).collect()}
        kinds = [y for y, held in self.own.values() if held], [y for y, held in self.own.values() if not held]
        if not all(min(sum(k), len(k) - sum(k)) >= 5 for k in kinds):  # too few to hold any out: all serve for both
            self.own = {i: (y, None) for i, (y, _) in self.own.items()}
        self.rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(chars_col).cast("double").alias("chars"), (F.col(marks_col) if marks_col else F.lit(None)).cast("array<int>").alias("marks"))
        self.given = docs.sparkSession.sparkContext.broadcast(self.own)

    def sample(self) -> DataFrame:
        """The labelled rows of the sample."""
        ids = self.rows.sparkSession.createDataFrame([(i,) for i in self.own], self.rows.select("id").schema)  # 2 MAX_LABELLED at most
        return materialize(self.rows.join(F.broadcast(ids), "id", "left_semi"), "labelled")

    def counted(self, rows: DataFrame, rounds: list[Views], pseudo: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts (bad, good) of words and metadata: over labelled rows, or over the others by what earlier rounds are sure of."""
        given = self.given
        earlier = rows.sparkSession.sparkContext.broadcast(rounds)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, page = np.zeros((2, WORDS), np.int64), np.zeros((2, PAGE), np.int64)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, x in _batches(batch, "text", "lang", "source", "chars", "marks"):
                    of = [given.value.get(i) for i in ids[a : a + len(x)]]
                    known = np.array([o is not None for o in of], bool)
                    for_text = for_page = np.array([-1 if o is None or o[1] else o[0] for o in of], np.int64)
                    if pseudo:
                        for_text, for_page = np.full(len(x), -1), np.full(len(x), -1)
                        for views in earlier.value:
                            t, p = map(_chance, views.logits(x))
                            sure = lambda c: np.where(c > 1 - SURE, 1, np.where(c < SURE, 0, -1))
                            for_text, for_page = np.where(for_text < 0, sure(p), for_text), np.where(for_page < 0, sure(t), for_page)
                        for_text[known] = for_page[known] = -1
                    for y in (0, 1):
                        words[y] += np.bincount(x.bucket[for_text[x.doc] == y], minlength=WORDS)
                        page[y] += np.bincount(x.page[for_page[x.page_doc] == y], minlength=PAGE)
            both = np.concatenate([words, page], 1)
            y, at = np.nonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(both[y, at])], ["y", "at", "n"])

        got = rows.mapInArrow(count, "y int, at int, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow()  # 2 (WORDS + PAGE) at most
        out = np.zeros((2, WORDS + PAGE))
        out[got["y"].to_numpy(), got["at"].to_numpy()] = got["n"].to_numpy()
        return out[:, :WORDS], out[:, WORDS:]

    def calibrated(self, sample: DataFrame, views: Views) -> tuple[Views, np.ndarray, np.ndarray]:
        """The views with logits fitted on held-out labels; those rows' logits (text, metadata) and labels."""
        given, model = self.given, sample.sparkSession.sparkContext.broadcast(views)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, x in _batches(batch, "text", "lang", "source", "chars", "marks"):
                    own = [given.value[i] for i in ids[a : a + len(x)]]
                    use = np.array([held is not False for _, held in own], bool)
                    t, p = model.value.features(x)
                    yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in own], pa.int32()), pa.array(list(np.hstack([t, p])), pa.list_(pa.float64()))], ["y", "x"]).filter(pa.array(use))

        got = sample.mapInArrow(measure, "y int, x array<double>").toArrow()  # 2 MAX_LABELLED rows at most, but for repeated ids
        y = got["y"].to_numpy().astype(float)
        if not len(y) or y.min() == y.max():
            return views, np.zeros((0, 2)), y
        x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        order = np.lexsort(np.column_stack([x, y]).T)  # the sums don't depend on how rows came
        x, y = x[order], y[order]
        of_text, of_page = x[:, :-3], x[:, -3:]
        done = Views(views.words, views.page, Logistic.fit(of_text, y), Logistic.fit(of_page, y))
        return done, np.stack([done.text_fit.logit(of_text), done.page_fit.logit(of_page)], 1), y


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", marks_col: str | None = None, rounds: int = ROUNDS) -> QualityModel:
    """A model from ``labels`` (id, 0 or 1). Labels that are null or neither don't count; of several for a document the mean
    does, a tie being good. With labels of one kind or none on documents that are there, all documents score 1 (or 0 if all
    labels are 0). ``marks_col``: what ``page_view.with_marks`` gave the documents, if anything. ``rounds``: how often the views
    exchange pseudo-labels."""
    own = _Fit(docs, labels, id_col, text_col, lang_col, source_col, chars_col, label_col, marks_col)
    if len({y for y, _ in own.own.values()}) < 2:
        return QualityModel(None, None, float(next(iter(own.own.values()), (1, False))[0]))
    sample = own.sample()
    words, page = own.counted(sample, [], pseudo=False)
    done: list[Views] = []
    for _ in range(rounds + 1):
        more = own.counted(own.rows, done, pseudo=True) if done else (0, 0)
        views, logits, y = own.calibrated(sample, Views(_odds(words + more[0]), _odds(page + more[1])))
        if not len(logits):
            return QualityModel(None, None, float(y[0]) if len(y) else 1.0)
        done.append(views)
    discard(sample)
    return QualityModel(done[-1], Logistic.fit(logits, y))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", pages: DataFrame | None = None, page_of: Column | None = None, **columns: str) -> DataFrame:
    """For each row of ``docs``: its id, p_text, p_page, score, keep (score >= 0.5), toxic (by its words, where ``labels`` has
    a column toxic). Rows that repeat score the same; null columns are values of their own, a null text counts as empty; rows
    without an id are scored but never count as labelled; an empty table gives an empty result. Other columns are ignored. ``pages`` (url, html), if given, are web pages of documents;
    ``page_of``: the id of a page's document, as a column of ``pages``."""
    names = {"text_col": "text", "lang_col": "lang", "source_col": "source", "chars_col": "n_chars"} | {k: v for k, v in columns.items() if k != "label_col"}
    own = docs.select(F.col(id_col).alias("id"), *(F.col(v).alias(k) for k, v in names.items()))
    if pages is not None:
        own = with_marks(own, pages, page_of, "id", marks_col="marks_col")
    marks = own.columns[5:]
    label_col = columns.get("label_col", "quality")
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    out = fit(own, given, "id", *names, "label", *marks).scored(own, *names, *marks)
    toxic = fit_toxic(docs, labels, id_col, names["text_col"]).toxic(F.col("text_col")) if "toxic" in labels.columns else F.lit(False)
    return out.select(F.col("id").alias(id_col), "p_text", "p_page", "score", (F.col("score") >= 0.5).alias("keep"), toxic.alias("toxic"))
