"""Toxic documents by the words that labelled ones hold: log-odds of words, added up and cut where held-out labels say.

Words are counted over all labelled documents; only the words that tell most, and counts of scores, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import bloom_probe, bloom_words, discard, filter_bits, materialize

#: So many words count at most, each in so many toxic documents at least and so many deviations beyond chance.
MAX_WORDS, LEAST_DOCUMENTS, LEAST_DEVIATIONS = 512, 3, 5.0
#: Scores are cut at multiples of this.
STEP = 0.25


def word_hashes(text: Column) -> Column:
    """Hashes of a text's different words: runs of letters, lower-cased. None for a null or empty text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.hash(w)))


@dataclass
class ToxicModel:
    """Log-odds by word hash; a document whose words add up to ``least`` is toxic. Without words none is."""

    weights: dict[int, float]
    least: float = STEP

    def score(self, hashes: Column) -> Column:
        if not self.weights:
            return F.lit(0.0)
        known = F.array_intersect(hashes, F.array(*map(F.lit, self.weights)))
        weight = F.create_map(*(F.lit(x) for pair in self.weights.items() for x in pair))
        return F.aggregate(known, F.lit(0.0), lambda a, h: a + F.element_at(weight, h))

    def toxic(self, text: Column) -> Column:
        return self.score(word_hashes(text)) >= self.least if self.weights else F.lit(False)


def fit_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A model from all ``labels`` (id, 0 or 1). Labels that are null or neither don't count; of several for a document the
    mean does, a tie being toxic. The cut comes from a quarter of the labelled documents, by words of the others, where there
    are enough of both kinds; the words then come from all."""
    given = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id2")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    bits = filter_bits(given.count())
    own = bloom_probe(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), bloom_words(given, "id2", bits), F.col("id"), bits, "maybe").filter("maybe")
    held = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(4)) == 0
    joined = own.select("id", word_hashes(F.col("text")).alias("words")).join(given, F.col("id") == F.col("id2"))
    rows = materialize(joined.select("words", "y", held.alias("held")), "toxic-words")
    seen = {(r["held"], r["y"]): r["n"] for r in rows.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(seen.get((h, y), 0) for h in (False, True) for y in (0, 1)) >= 5:
        first = _weighted(rows.filter("not held"), seen[False, 1], seen[False, 0])
        cut = rows.filter("held")
    else:  # too few to hold any out
        first, cut = None, rows
    model = _weighted(rows, *(seen.get((False, y), 0) + seen.get((True, y), 0) for y in (1, 0)))
    judge = first if first and first.weights else model
    if not model.weights:
        discard(rows)
        return model
    steps = cut.groupBy(F.floor(judge.score(F.col("words")) / STEP).cast("int").alias("step"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    discard(rows)
    total = {y: sum(r["n"] for r in steps if r["y"] == y) for y in (0, 1)}
    caught = lambda at, y: sum(r["n"] for r in steps if r["y"] == y and r["step"] >= at) / max(total[y], 1)
    model.least = STEP * max(({r["step"] for r in steps if r["step"] > 0} or {1}), key=lambda at: (caught(at, 1) - caught(at, 0), -at))
    return model


def _weighted(rows: DataFrame, bad: int, good: int) -> ToxicModel:
    """Words and their log-odds from ``rows`` (words, y), of which so many are toxic and so many not."""
    if not bad or not good:
        return ToxicModel({})
    p = bad / (bad + good)
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("z", (F.col("a") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p))))
    best = counts.filter((F.col("a") >= LEAST_DOCUMENTS) & (F.col("z") >= LEAST_DEVIATIONS)).orderBy(F.col("z").desc(), "word").limit(MAX_WORDS).collect()
    return ToxicModel({r["word"]: math.log((r["a"] + 0.5) / (bad + 1)) - math.log((r["n"] - r["a"] + 0.5) / (good + 1)) for r in best})
