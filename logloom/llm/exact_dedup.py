"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

The first pass counts, for every text hash, the two slots that it sets in a filter; slots that were set once belong to a
single row. The second pass probes the slots that were set twice: a hash that misses is surely single and its row passes
straight through; the others are grouped exactly. Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import attach_groups, bloom_probe, bloom_words, filter_bits, materialize

SPACE = r"[\x20\x09-\x0D]+"


def text_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with every run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; rows without an id come after those with one, and of rows with the
    same id and text exactly one stays. A null text equals an empty one. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    keyed = materialize(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_hash(F.col(text_col)).alias("sha")), "keys")
    total = keyed.count()
    bits = filter_bits(total)
    split = bloom_probe(keyed, bloom_words(keyed, "sha", bits, least=2), F.col("sha"), bits, "maybe")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = materialize(split.filter("maybe").groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    checked = attach_groups(split.filter("maybe").select("id", "row", "sha"), groups, "sha", "n", total, F.concat(F.lit("row "), F.col("row").cast("string")))
    out = lambda df, keep, n, kept: df.select(F.col("id").alias(id_col), keep.alias("keep_id"), n.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
    single = out(split.filter("not maybe"), F.col("id"), F.lit(1).cast("long"), F.lit(True))
    return single.unionByName(out(checked, F.col("first.id"), F.col("n"), F.col("row") == F.col("first.row")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts of single rows are never shuffled.

    The same rules as ``exact_groups``; of rows with the same id and text any one stays.
    """
    keyed = materialize(docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("sha")), "keys")
    bits = filter_bits(keyed.count())
    words = materialize(bloom_words(keyed, "sha", bits, least=2), "filter")
    maybe = bloom_probe(keyed, words, F.col("sha"), bits, "maybe").filter("maybe")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    first = maybe.groupBy("sha").agg(F.min(order).alias("first")).select(F.col("sha").alias("__sha2"), F.col("first.id").alias("__first"))
    rows = bloom_probe(docs.withColumn("__sha", text_hash(F.col(text_col))), words, F.col("__sha"), bits, "__maybe")
    checked = rows.filter("__maybe").join(first, (F.col("__sha") == F.col("__sha2")) & F.col(id_col).eqNullSafe(F.col("__first")), "left_semi")
    checked = checked.dropDuplicates([id_col, "__sha"])
    return rows.filter("not __maybe").select(*docs.columns).unionByName(checked.select(*docs.columns))
