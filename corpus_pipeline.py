"""A corpus from documents: bad ones, copies, near copies and leaked benchmark texts go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize
from logloom.llm.decontaminate import drop_contaminated
from logloom.llm.exact_dedup import drop_exact_duplicates
from logloom.llm.jaccard_join import drop_near_duplicates
from logloom.llm.packing import digests, packed
from logloom.llm.page_view import with_marks
from logloom.llm.quality import fit
from logloom.llm.queries import page_of, table, tokenizer_path
from logloom.llm.toxic import fit_toxic


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the co-trained classifier nor the words of toxic ones reject."""
    labels = table(spark, sf_dir, "labels")
    own = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source", "n_chars")}
    rows = with_marks(docs.withColumnsRenamed(own), table(spark, sf_dir, "pages"), page_of())
    model, toxic = fit(rows, labels, marks_col="marks"), fit_toxic(docs, labels)
    kept = model.scored(rows.filter(~toxic.toxic(F.col("text"))), marks_col="marks").filter("score >= 0.5")
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the document with the smallest id."""
    return drop_near_duplicates(docs, k=5, least=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with target proportions of sources in each."""
    return digests(packed(docs, tokenizer_path()))


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("packing", packing)]

#: Jaccard components and the classifier have no SQL; tests/llm holds what the stages are compared with.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
