"""What a document's web page says about it besides its text: address, title and markup, as hashed marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import bloom_probe, bloom_words, filter_bits, materialize

#: Marks are hashed into so many.
MARKS = 1 << 12


def _power(n: Column) -> Column:
    return F.floor(F.log2(n + F.lit(1))).cast("string")


def page_marks(url: Column, html: Column) -> Column:
    """An array of hashed marks: host, names in the query, depth of the path; language, length and characters of the title;
    paragraphs, their length, links. Null counts as empty; what is missing is a mark of its own."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    title = F.replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&"))
    eighths = lambda pattern: F.floor(F.regexp_count(title, F.lit(pattern)) * 8 / F.greatest(F.length(title), F.lit(1))).cast("string")
    paragraphs = F.regexp_count(html, F.lit(r"(?i)<p[\s>]"))
    values = {
        "host": F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)), r"^(www|m|blog)\.", ""),
        "query": F.regexp_replace(F.regexp_extract(url, r"[?#](.*)", 1), r"=[^&]*", ""),
        "depth": F.regexp_count(url, F.lit("/")).cast("string"),
        "lang": F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([a-z]+)", 1)),
        "title": _power(F.length(title)),
        "other": F.least(F.regexp_count(title, F.lit(r"[^\p{L}\p{N}\s.,]")), F.lit(9)).cast("string"),
        "upper": eighths(r"\p{Lu}"),
        "digits": eighths(r"\p{N}"),
        "paragraphs": _power(paragraphs),
        "long": _power(F.length(html) / (paragraphs + 1)),
        "links": _power(F.regexp_count(html, F.lit(r"(?i)<a\s"))),
    }
    return F.array(*(F.pmod(F.xxhash64(F.lit(name), value), F.lit(MARKS)).cast("int") for name, value in values.items()))


def with_marks(docs: DataFrame, pages: DataFrame, page_of: Column, id_col: str = "doc_id", url_col: str = "url", html_col: str = "html", marks_col: str = "marks") -> DataFrame:
    """``docs`` with ``marks_col``: the marks of all pages whose ``page_of`` is the row's id, null where there is none.

    Of several pages of a document each mark is named once, so no row holds more than MARKS. Rows without an id have no page;
    rows that repeat get the same marks. Only rows that a Bloom filter of the pages' ids lets through are shuffled, once, and
    written with their marks; all others stay where they are.
    """
    if marks_col in docs.columns:
        raise ValueError(f"docs has a column {marks_col} already")
    of = page_of.cast(docs.schema[id_col].dataType)
    single = pages.select(of.alias("__page"), F.explode(page_marks(F.col(url_col), F.col(html_col))).alias("mark")).filter(F.col("__page").isNotNull())
    marks = materialize(single.groupBy("__page").agg(F.sort_array(F.collect_set("mark")).alias(marks_col)), "marks")
    bits = filter_bits(marks.count())
    words = materialize(bloom_words(marks, "__page", bits), "page-filter")
    flag = max([*docs.columns, ""], key=len) + "_maybe"  # longer than any, so no column of docs
    probed = bloom_probe(docs, words, F.col(id_col), bits, flag)
    maybe = F.col(flag) & F.col(id_col).isNotNull()
    near = probed.filter(maybe)
    found = near.join(marks, near[id_col] == marks["__page"], "left").select(*(near[c] for c in docs.columns), marks[marks_col])
    rest = probed.filter(~maybe).select(*docs.columns, F.lit(None).cast("array<int>").alias(marks_col))
    return rest.unionByName(materialize(found, "with-marks"))
