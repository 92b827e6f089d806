"""The stores of jobs and cases, metadata, reputations in time and pages by their last key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import indicators, normalize, profile, scoring, store, views
from logloom.operators.results import audit
from logloom.sources.stored import stored


def test_results_of_jobs(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = lambda *v: spark.createDataFrame([(x, {"k": x}) for x in v], "a long, m map<string,long>")
    assert store.read_results(spark, root, "x", "a long").count() == 0
    for form in ("parquet", "json", "csv"):
        store.write_result(rows(1, 2), root, form, "j1", form)
        store.write_result(rows(3), root, form, "j2", form)
        store.write_result(rows(4, 5, 6), root, form, "j1", form)
        own = store.read_results(spark, root, form, "a long", form=form)
        assert sorted((r["job_id"], r["a"]) for r in own.collect()) == [("j1", 4), ("j1", 5), ("j1", 6), ("j2", 3)]
        some = store.read_results(spark, root, form, "a long", ["j2", "none"], form)
        assert [r["a"] for r in some.collect()] == [3]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(job_id" in plan or "PartitionFilters: [job_id" in plan

    @F.udf("long")
    def broken(x):
        raise ValueError("halfway")

    with pytest.raises(Exception, match="halfway"):
        store.write_result(rows(7, 8).withColumn("a", broken("a")), root, "parquet", "j1")
    assert store.read_results(spark, root, "parquet", "a long", ["j1"]).count() == 3


def test_cases(spark, tmp_path):
    cases = store.Cases(spark, str(tmp_path / "cases"))
    assert cases.listed().collect() == [] and cases.versions() == []
    a, b = cases.create("One", analyst="x", job_ids=["j1"]), cases.create("Two")
    assert len(a) == 12 and [r["name"] for r in cases.listed().collect()] == ["Two", "One"]
    before = cases.get(a).first()
    cases.update(a, case_number="7", analyst=None, job_ids=["j1", "j2"])
    now = cases.get(a).first()
    assert (now["name"], now["case_number"], now["analyst"], now["job_ids"]) == ("One", "7", "x", ["j1", "j2"])
    assert now["created_at"] == before["created_at"] and now["updated_at"] > before["updated_at"]
    assert [r["case_id"] for r in cases.listed().collect()] == [a, b]
    cases.add_job(b, "j9")
    cases.add_job(b, "j9")
    cases.remove_job(a, "j1")
    assert {r["case_id"]: r["job_ids"] for r in cases.table().collect()} == {a: ["j2"], b: ["j9"]}
    assert len(cases.versions()) == store.KEPT + 1
    # a version that was left half-written neither counts nor stands in the way
    latest = cases.versions()[-1]
    (tmp_path / "cases" / f"v{latest + 1}").mkdir()
    (tmp_path / "cases" / f"v{latest + 1}" / "part-0.parquet").write_text("cut")
    assert cases.table().count() == 2
    cases.delete(a)
    assert [r["case_id"] for r in cases.table().collect()] == [b] and cases.versions()[-1] == latest + 2
    for change in (lambda: cases.update(a, name="x"), lambda: cases.delete(a), lambda: cases.add_job("no", "j")):
        with pytest.raises(KeyError):
            change()
    with pytest.raises(ValueError):
        cases.update(b, color="red")
    cases.update(b, name="It's \"two\" ü")
    assert cases.get(b).first()["name"] == "It's \"two\" ü"


def test_audit_is_appended(spark, tmp_path):
    for what in ("one", "two", "two"):
        audit(spark, str(tmp_path), what, by="x")
    assert sorted((r["event"], r["details"]["by"]) for r in spark.read.json(str(tmp_path / "audit")).collect()) == [("one", "x"), ("two", "x"), ("two", "x")]


def test_fields_of_metadata(spark):
    """Addresses, packages and features come out alike whether fields are columns or metadata."""
    rows = [(1, "2025-01-01 23:00:00", "auth_failure", "x", "eve", "sshd", "h1", None, "8.8.8.8", None, "nmap", "install"), (2, "2025-01-01 10:00:00", "log_entry", "from 10.0.0.1", None, None, "h2", "/tmp/x", "10.1.1.1", "1000", "nmap", "remove"), (3, None, None, None, *[None] * 8)]
    names = ["user", "process", "hostname", "path", "src_ip", "size", "package", "action"]
    plain = spark.createDataFrame(rows, "seq long, t string, event_type string, description string, " + ", ".join(f"{c} string" for c in names)).withColumn("ts", F.to_timestamp("t"))
    held = stored(normalize.with_metadata(plain, *names).drop(*names), "meta")
    assert dict(held.dtypes)["metadata"] == "variant"
    for f in (indicators.extracted, profile.packages, lambda e: scoring.features(e).select("seq", *scoring.FEATURES)):
        assert sorted(map(tuple, f(held).collect()), key=repr) == sorted(map(tuple, f(plain).collect()), key=repr)
    assert [r[0] for r in held.orderBy("seq").select(normalize.field(held, "size", "long")).collect()] == [None, 1000, None]


def test_reputations_in_time(spark):
    draw, day = random.Random(3), datetime.timedelta(days=1)
    start = datetime.datetime(2024, 1, 1)
    values = ["8.8.8.8"] * 30 + [f"9.9.9.{i}" for i in range(10)]
    seen = [("ips", draw.choice(values), start + draw.random() * 500 * day) for _ in range(600)] + [("ips", "8.8.8.8", start), ("domains", "8.8.8.8", start)]
    rep = [(f" {draw.choice(values)} ", draw.randrange(101), start + draw.randrange(500) * day) for _ in range(60)] + [("8.8.8.8", 30, start), ("8.8.8.8", 80, start), (None, 5, start), ("8.8.8.8", None, start), ("8.8.8.8", 5, None)]
    own = spark.createDataFrame(seen, "category string, value string, ts timestamp")
    kb = spark.createDataFrame([(1, "9.9.9.1", "t", None), (2, "9.9.9.2", "t", "high")], "nr int, value string, threat string, confidence string")
    got = indicators.looked_up(own, kb, spark.createDataFrame(rep, "value string, score int, at timestamp")).collect()

    def at(category, value, ts):
        held = [(a, s) for v, s, a in rep if v and s is not None and a and v.strip() == value and a <= ts <= a + 90 * day]
        return max(held)[1] if held and category == "ips" else None

    def verdict(value, score):
        known = {"9.9.9.1": "suspicious", "9.9.9.2": "malicious"}.get(value)
        return known or ("unknown" if score is None else "malicious" if score >= 50 else "suspicious" if score >= 25 else "clean")

    assert sorted((r["category"], r["value"], r["ts"], r["abuse_score"], r["verdict"]) for r in got if r["abuse_score"] is not None) == sorted((c, v, t, s, verdict(v, s)) for c, v, t in seen if (s := at(c, v, t)) is not None)
    assert len(got) == len(seen) and {r["verdict"] for r in got} == {"malicious", "suspicious", "clean", "unknown"}


@pytest.mark.parametrize("sort", ["ts", "event_type", "source", "description", "anomaly_score"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_last_key(spark, sort, descending):
    draw = random.Random(4)
    words = ["Äpfel", "apfel", "Apfel", "zebra", "Zoo", "_x", "10", "9", "", None, "É", "e"]
    rows = [(i, draw.choice([None, f"2025-01-0{draw.randrange(1, 4)} 00:00:00"]), draw.choice(words), draw.choice(words), draw.choice(words), draw.choice([None, 0.0, 0.5, 0.9])) for i in range(130)]
    events = spark.createDataFrame(rows, "seq long, t string, event_type string, source string, description string, anomaly_score double").withColumn("ts", F.to_timestamp("t"))
    after, keyed = None, []
    for page in range(7):
        own = views.event_page(events, "", sort, descending, after=after) if page else views.event_page(events, "", sort, descending)
        by_offset = views.event_page(events, "", sort, descending, page=page)
        got = own.collect()
        assert [r["seq"] for r in got] == [r["seq"] for r in by_offset.collect()]
        keyed += [r["seq"] for r in got]
        if got:
            after = (got[-1][sort], got[-1]["seq"])
    assert sorted(keyed) == list(range(130))
    if sort == "source":  # a dictionary's order: marks, numbers, letters whatever their case and accents
        first = [r["source"] for r in events.orderBy(views.page_key(events, "source").asc_nulls_last()).collect()]
        known = [w for i, w in enumerate(first) if w is not None and (not i or first[i - 1] != w)]
        assert known == ["", "_x", "10", "9", "apfel", "Apfel", "Äpfel", "e", "É", "zebra", "Zoo"]
