"""The metadata view of the quality classifier, and what rounds of co-training give it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import quality, queries
from logloom.llm.page_view import MARKS, page_marks, with_marks

SF = "/root/testdata/sf0.1"


def marked(spark):
    docs, pages = (queries.table(spark, SF, t) for t in ("documents", "pages"))
    return with_marks(docs, pages, queries.page_of())


def judged(rows, labels, test, rounds):
    model = quality.fit(rows, labels.filter(~test), marks_col="marks", rounds=rounds)
    held = rows.join(labels.filter(test).select("doc_id", "quality"), "doc_id")
    return model.scored(held, marks_col="marks").select("quality", "p_text", "p_page", "score", F.col("marks").isNotNull().alias("known")).toPandas()


def right(got, column):
    return np.mean((got[column].to_numpy() >= 0.5) == (got["quality"].to_numpy() == 1))


def test_metadata_view_beats_the_base_rate(spark):
    test = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    got = judged(marked(spark), queries.table(spark, SF, "labels"), test, quality.ROUNDS)
    known = got[got["known"]]
    assert len(known) > 100
    assert right(known, "p_page") > known["quality"].mean() + 0.04
    assert right(got, "p_page") > got["quality"].mean()


def test_rounds_help_where_labels_are_few(spark):
    """The same 62 labelled documents, without an exchange and with two rounds of it."""
    labels, test = queries.table(spark, SF, "labels"), F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    few = labels.filter(test | (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(60)) == 0))
    rows = marked(spark)
    alone, taught = (judged(rows, few, test, rounds) for rounds in (0, 2))
    assert right(taught, "p_page") > right(alone, "p_page")
    assert right(taught, "p_text") >= right(alone, "p_text")
    assert right(taught, "score") > right(alone, "score")


def test_page_of_an_address(spark):
    urls = {"http://a.example.net/en/7817?utm_source=feed": 7817, "http://m.b.com/en/4033.html": 4033, "https://c.com/en/5462#top": 5462, "http://d.com/en/1837/": 1837, "http://e.com/x?id=/5": None, "": None, None: None, "http://f.com/en/99999999999999999999": None}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", queries.page_of().alias("id")).collect()
    assert {r["url"]: r["id"] for r in got} == urls


def test_marks_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, None, 2), (3, "c", 3), (None, "d", 4), (None, "d", 5)], "doc_id long, text string, __far int")
    pages = spark.createDataFrame([(1, "http://x.com/1", "<title>A|B</title><p>t"), (1, "http://x.com/1", "<title>A|B</title><p>t"), (1, "http://y.com/1", "<p>t"), (2, None, None), (None, "http://z.com", "<p>")], "of long, url string, html string")
    own = {r["of"]: r for r in pages.groupBy("of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(page_marks(F.col("url"), F.col("html")))))).alias("m")).collect()}
    got = with_marks(docs, pages, F.col("of")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["__far"]) for r in got) == sorted((str(r["doc_id"]), str(r["text"]), r["__far"]) for r in docs.collect())
    for r in got:
        assert r["marks"] == (own[r["doc_id"]]["m"] if r["doc_id"] in (1, 2) else None)
        assert all(0 <= m < MARKS for m in r["marks"] or ())
    assert {r["marks"] for r in with_marks(docs, pages.limit(0), F.col("of")).collect()} == {None}
    assert with_marks(docs.limit(0), pages, F.col("of")).count() == 0
    with pytest.raises(ValueError, match="already"):
        with_marks(docs.withColumn("marks", F.lit(1)), pages, F.col("of"))


def test_quality_with_pages_of_odd_rows(spark):
    rows = [(i, "good plain words here" if i % 2 else "!! || ## 77", "en", "s", 20) for i in range(60)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.filter("doc_id < 40").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", "<title>" + ("plain" if i % 2 else "||||") + "</title>") for i in range(30)] + [(None, None, None)], "page_id long, url string, html string")
    for given in (pages, pages.limit(0)):
        got = quality.quality(docs, labels, pages=given, page_of=queries.page_of()).collect()
        assert len(got) == len(rows) and all(r["keep"] == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] and r["doc_id"] >= 40)
