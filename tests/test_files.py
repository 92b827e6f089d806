"""Sources that read files by ranges, searches for many values, exact selection and one-pass findings, against plain Python."""

import hashlib
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.operators import evidence, findings, normalize, patterns, results
from logloom.plans import bindings
from logloom.sources import files as source
from logloom.sources import logs, stored


def test_digests_by_chunks(spark, tmp_path, monkeypatch):
    draw = random.Random(1)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    held = {"a.bin": draw.randbytes(3_000_001), "deep/empty.log": b"", "deep/er/ä b.txt": "wörter\n".encode() * 999, "same": b"x", "deep/same": b"x"}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    with (tmp_path / "sparse.dd").open("wb") as f:
        f.truncate(300 << 20)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["file"].removeprefix("file://").removeprefix(f"{tmp_path}/"): (r["size"], r["md5"], r["sha256"]) for r in evidence.digests(spark, path).collect()}
        zero = hashlib.sha256()
        for _ in range(300):
            zero.update(bytes(1 << 20))
        assert got.pop("sparse.dd")[::2] == (300 << 20, zero.hexdigest())
        assert got == {n: (len(d), hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in held.items()}
    (tmp_path / "none").mkdir()
    assert evidence.digests(spark, str(tmp_path / "none")).collect() == []
    assert evidence.digests(spark, str(tmp_path / "a.bin")).first()["size"] == 3_000_001
    monkeypatch.setattr(source, "TASK_BYTES", 1000)
    parts = source.dealt([("f", 0, n, n, 0.0) for n in (400, 400, 400, 5000, 1)])
    assert [len(p.ranges) for p in parts] == [2, 1, 1, 1]


def login(layout, kind, user, at, host=b"10.1.2.3"):
    if layout == 400:
        return source.LAYOUTS[400].pack(kind, 7, b"pts/0", b"", user, host, 0, 0, 0, at, 5, 0, 0, 0, 0, b"")
    return source.LAYOUTS[384].pack(kind, 7, b"pts/0", b"", user, host, 0, 0, 0, at, 5, 0, 0, 0, 0, b"")


@pytest.mark.parametrize("layout", [384, 400])
def test_login_records_of_many_ranges(spark, tmp_path, layout):
    assert source.LAYOUTS[layout].size == layout
    n = 384 * 400 + 25 if layout == 400 else 150_001  # 400 wins where both sizes divide the file
    one = [login(layout, k, u, 1_700_000_000 + k) for k, u in ((7, b"root"), (8, b"eve"), (2, b"reboot"), (1, b"runlevel"), (7, b""))]
    data = b"".join(one[i % 5] for i in range(n))
    (tmp_path / "wtmp").write_bytes(data if layout == 400 else data + b"cut")
    (tmp_path / "old.btmp").write_bytes(one[0])
    (tmp_path / "utmpdb").write_bytes(one[1] * 2)
    (tmp_path / "notes.txt").write_bytes(one[0])
    (tmp_path / "lastlog").write_bytes(struct.pack("<i32s256s", 0, b"", b"") + struct.pack("<i32s256s", 1_700_000_000, b"tty1", b"h"))
    got = logs.read_logins(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 1
    by = {(r["name"], r["event_type"], r["user"]): (r["n"], r["lo"], r["hi"]) for r in got.groupBy(F.element_at(F.split("file", "/"), -1).alias("name"), "event_type", "user").agg(F.count("*").alias("n"), F.min("line_number").alias("lo"), F.max("line_number").alias("hi")).collect()}
    whole = [i + 1 for i in range(n)]
    pick = lambda k: [i for i in whole if (i - 1) % 5 == k]
    want = {("wtmp", t, u): (len(pick(k)), pick(k)[0], pick(k)[-1]) for k, (t, u) in enumerate((("auth_success", "root"), ("session_closed", "eve"), ("system_boot", "reboot")))}
    want |= {("old.btmp", "auth_failure", "root"): (1, 1, 1), ("utmpdb", "session_closed", "eve"): (2, 1, 2), ("lastlog", "auth_success", "1"): (1, 2, 2)}
    if layout == 384:  # one record alone, and two: no size but 384 divides them
        assert by == want
    else:
        assert {k: v for k, v in by.items()} == want
    first = got.filter("event_type = 'auth_success' and user = 'root'").orderBy("line_number").first()
    assert (first["ts"].timestamp(), first["terminal"], first["src_ip"], first["pid"]) == (1_700_000_007, "pts/0", "10.1.2.3", "7")


def test_login_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "TASK_BYTES", 384 * 10)
    (tmp_path / "wtmp").write_bytes(login(384, 7, b"root", 1) * 101)
    parts = source._Logins(source.listed(str(tmp_path))).partitions()
    assert len(parts) == 11 and sum(len(list(source._Logins([]).read(p))) > 0 for p in parts) == 11
    rows = [r for p in parts for b in source._Logins([]).read(p) for r in b.column(1).to_pylist()]
    assert rows == list(range(1, 102))


def test_detection(spark, tmp_path):
    made = {
        "a.dd": b"\x00\x01", "b.log": b"EVF\x09 x", "c.vmdk.txt": b"# Disk DescriptorFile\n", "d.txt": b"plain", "e": b"PK\x03\x04zip", "f": "grüße".encode() * 200, "g": b"\x00\xff\xfe",
        "h.gz": b"\x1f\x8b", "i.TAR": b"", "j": b"\0" * 257 + b"ustar", "k.e01": b"text", ".log": b"\x89PNGxx", "l.evtx": b"ElfFile\0",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    for name, first in (("big", b"\xff" * 512), ("big2", b"a" * 512)):
        with (tmp_path / name).open("wb") as f:
            f.write(first)
            f.truncate(10 << 30)
    got = {r["name"]: (r["type"], r["mime_type"], r["size"]) for r in logs.detected(spark, str(tmp_path)).collect()}
    want = {"a.dd": "disk_image", "b.log": "disk_image", "c.vmdk.txt": "disk_image", "d.txt": "logs", "e": "archive", "f": "logs", "g": "unknown", "h.gz": "archive", "i.TAR": "archive", "j": "archive", "k.e01": "disk_image", ".log": "unknown", "l.evtx": "logs", "big": "disk_image", "big2": "logs"}
    assert {n: t for n, (t, _, _) in got.items()} == want
    assert got["big"][2] == 10 << 30 and got["d.txt"][1] == "text/plain" and got["g"][1] == "application/octet-stream"


def test_detected_folders(spark, tmp_path):
    for name in ("uac/bodyfile.txt", "uac/x/y.bin", "logs/a.log", "logs/b.TXT", "live/live_response/deep/z.txt", "mixed/a.log", "mixed/b.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r["path"].removeprefix(str(tmp_path)).lstrip("/"): r["type"] for r in logs.detected_folders(spark, str(tmp_path)).collect()}
    assert got == {"": "logs", "uac": "uac_dump", "uac/x": "unknown", "logs": "logs", "live": "uac_dump", "live/live_response": "logs", "live/live_response/deep": "logs", "mixed": "unknown"}


def test_artifacts_of_many_files_in_one_plan(spark, tmp_path):
    want = []
    for i in range(300):
        width = i % 5 + 1
        names = [f"c{i}_{j}" for j in range(width)]
        rows = [[f"{i}.{k}.{j}" for j in range(width)] for k in range(i % 3)]
        (tmp_path / f"t{i}.csv").write_text("\n".join(",".join(r) for r in [names, *rows]) + "\n")
        want += [(f"uac_artifacts/t{i}", dict(zip(names, r, strict=True))) for r in rows]
    (tmp_path / "odd x.csv").write_text('name,"a, b",name,,name\n"x, y",2,3,4,5\nshort,1\nname,"a, b",name,,name\nlong,1,2,3,4,5,6\n')
    (tmp_path / "empty.csv").write_text("")
    odd = ["name", "a, b", "name.1", "Unnamed: 3", "name.2"]
    want += [("uac_artifacts/odd x", dict(zip(odd, v, strict=True))) for v in (["x, y", "2", "3", "4", "5"], ["short", "1", None, None, None], ["name", "a, b", "name", None, "name"])]
    own = logs.artifact_csv(spark, str(tmp_path))
    key = lambda r: (r[0], sorted((k, v or "") for k, v in r[1].items()))
    assert sorted(((r["source"], r["fields"]) for r in own.collect()), key=key) == sorted(want, key=key)
    assert own._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_matches_against_brute_force(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcä😀 .") for _ in range(draw.choice([0, 3, 40, 300]))) for _ in range(300)]
    values = {"".join(draw.choice("abcä😀 .") for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 20]))) for _ in range(400)} | {"A", "AB", "ab", "", "a", texts[5] + "x", texts[7]}
    texts += [None, "", "x" * 700_000 + "ABCabc needle-in-a-haystack", "Ab" * 1000]
    values |= {"needle-in-a-haystack", "NEEDLE", "x" * 50}
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, description string").repartition(5)
    kb = spark.createDataFrame([(v,) for v in [*sorted(values), None, "a"]], "value string")
    got = sorted(tuple(r) for r in patterns.matches(rows, kb, "seq", "description", "value").collect())
    assert got == sorted((i, v) for i, t in enumerate(texts) for v in values if v and t and v.lower() in t.lower())
    assert patterns.matches(rows, kb.limit(0), "seq", "description", "value").count() == 0


def test_matches_of_a_million_values(spark):
    """As many values as one likes, with nothing collected but bitmaps."""
    kb = spark.range(1_000_000).select(F.concat(F.lit("host-"), F.hex(F.xxhash64("id")), F.lit(".example")).alias("value"))
    some = spark.range(0, 1_000_000, 5000).select(F.col("id").alias("seq"), F.concat(F.lit("seen HOST-"), F.hex(F.xxhash64("id")), F.lit(".EXAMPLE and host-zz.example")).alias("description"))
    got = patterns.matches(some, kb, "seq", "description", "value")
    assert got.count() == 200 and got.select("seq").distinct().count() == 200


def test_matches_broadcast_few_values_only(spark, tmp_path):
    """By the size of the file alone, the planner would send all these values through the driver."""
    spark.range(200_000).select(F.concat(F.lit("User"), "id").alias("value")).write.parquet(str(tmp_path / "kb"))
    kb = spark.read.parquet(str(tmp_path / "kb"))
    some = spark.range(300).select(F.col("id").alias("seq"), F.concat(F.lit("of user"), F.col("id") * 100).alias("description"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many, few = (patterns.matches(some, v, "seq", "description", "value") for v in (kb, kb.limit(10)))
    assert "Broadcast" not in plan(many) and "SortMergeJoin" in plan(many)
    assert "BroadcastHashJoin" in plan(few)
    # user12300 holds the values User1, User12, User123, User1230 and User12300
    assert many.count() == sum(len(str(i * 100)) for i in range(300))


@pytest.mark.parametrize("few", [3, 1 << 14])
def test_exact_selection(spark, few, monkeypatch):
    monkeypatch.setattr(stored, "FEW", few)
    monkeypatch.setattr(stored, "RANGES", 8)
    draw = np.random.default_rng(2)
    for v in (draw.standard_normal(999), np.repeat([1.0, 1.0 + 2e-16, 5.0], 40), np.array([3.0]), np.array([1e300, -1e300, 0.0, 1e-300]), np.round(draw.random(500), 1)):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
        for share in (0.0, 0.1, 0.5, 0.999, 1.0):
            assert stored.quantile(df, "v", share) == pytest.approx(np.quantile(v, share), rel=1e-12, abs=1e-300)
    assert stored.quantile(df.limit(0), "v", 0.5) is None


def test_numbers_of_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("seq"), F.lit("x").alias("t")).repartition(7)
    got = stored.numbered(rows, F.col("seq")).collect()
    assert sorted((r["seq"], r["nr"]) for r in got) == [(i, i + 1) for i in range(5000)]
    assert stored.numbered(rows.limit(0), F.col("seq")).collect() == []


def scans(df):
    return sum(df._jdf.queryExecution().optimizedPlan().toString().count(x) for x in ("Relation [", "LogicalRDD", "Range ("))


def test_findings_in_one_pass(spark, tmp_path):
    """One scan of each table; the same findings as each check by itself."""
    draw = random.Random(6)
    said = ["shred -u x", "dd if=/dev/zero of=/x", "cat /dev/null > /var/log/a", "date", "hwclock -w", "insmod /tmp/x.ko", "rm -rf /tmp/x", "ls", "plain", None]
    for n, picks in ((300, said), (300, ["ls", "date"]), (40, ["ls"]), (12, said), (0, said)):
        rows = [(i, None if i % 17 == 3 else 1_700_000_000 + (i // 30) * 9000 * (1 if n > 40 else 3), draw.choice(picks), draw.choice(["", "/tmp/.ice-unix/x", None])) for i in range(n)]
        spark.createDataFrame(rows, "seq long, s long, description string, path string").withColumn("ts", F.timestamp_seconds("s")).write.mode("overwrite").parquet(f"{tmp_path}/e{n}{len(picks)}")
        events = spark.read.parquet(f"{tmp_path}/e{n}{len(picks)}")
        spark.createDataFrame([(i, f"/var/log/{i}", draw.choice([0, 5]), 200_000 * (i % 3), draw.choice([0, 7])) for i in range(n // 2)], "seq long, path string, mtime long, ctime long, size long").write.mode("overwrite").parquet(f"{tmp_path}/f{n}{len(picks)}")
        files = spark.read.parquet(f"{tmp_path}/f{n}{len(picks)}")
        each = [findings.wipe_tools(events), findings.log_clearing(events), findings.time_tools(events), findings.rootkits(events), findings.truncated_logs(files), findings.deletions(events)]
        each += [findings.timestomping(files), findings.gap_finding(events), findings.second_finding(events)] if n >= 20 else []
        own = findings.all_findings(events, files)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, normalize.united(*each).collect()))
        assert scans(own) == 2


def test_analysis_tells_digests_of_contents(spark, tmp_path):
    from logloom.operators import results

    (tmp_path / "evidence").mkdir()
    (tmp_path / "evidence" / "auth.log").write_bytes(b"one\ntwo\n")
    rows = [(i, f"2025-01-01 00:{i:02d}:00", "auth_failure", "Failed password", "auth.log" if i else "gone.log", i, i / 20) for i in range(20)]
    events = spark.createDataFrame(rows, "seq long, t string, event_type string, description string, source_file string, line_number long, anomaly_score double").withColumn("ts", F.to_timestamp("t")).withColumn("is_anomaly", F.col("seq") % 5 == 0).withColumn("source", F.lit("syslog"))
    events = events.withColumns({c: F.lit(None).cast("string") for c in ("user", "process", "hostname", "path", "src_ip", "package", "action", "unit", "size")})
    files = spark.createDataFrame([], "seq long, path string, mtime long, ctime long, size long, partition string, filesystem string")
    results.analyse(spark, events, files, str(tmp_path / "out"), "j", score=False, evidence_dir=str(tmp_path / "evidence"))
    md5, sha256 = hashlib.md5(b"one\ntwo\n").hexdigest(), hashlib.sha256(b"one\ntwo\n").hexdigest()
    summary = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert (summary["md5_hash"], summary["sha256_hash"], summary["n_files"], summary["evidence_bytes"]) == (md5, sha256, 1, 8)
    got = [(r["nr"], r["seq"], r["sha256_short"], r["location_detail"]) for r in spark.read.json(str(tmp_path / "out" / "provenance")).orderBy("nr").collect()]
    assert got == [(i + 1, 5 * i, f"{sha256[:16]}..." if i else "nicht berechnet", f"Zeile: {5 * i}") for i in range(4)]


TIMES = ["2025-01-15T08:00:01", "2025-01-15 08:00:01", "2025-01-15", "2025-1-5", "2025-01-15T08:00:01Z", "2025-01-15T08:00:01+02:00", "2025-01-15T08:00:01-0530", "2025-01-15T08:00:01.5Z", "2025-01-15T08:00:01.123456+00:00", "2025-01-15T08:00:01.5", " 2025-01-15 ", "2025-13-01", "2025-02-30", "2025-01-15T25:00:00", "nan", "-", "", None, "15.01.2025", "2025-01-15T8:0:1", "2025-01-15T08:00:01.123+0000", "2025-01-15 08:00:01Z", "2025-01-15T08:00"]


def test_times_as_text(spark):
    import datetime

    from logloom.functions import parse

    def want(raw):
        for form in ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
            try:
                t = datetime.datetime.strptime((raw or "").strip()[:26], form)
                return (t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)).timestamp()
            except ValueError:
                pass

    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", (F.unix_micros(parse.any_time(F.col("t"))) / 1e6).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == {t: want(t) for t in TIMES}


def test_known_indicators_and_bodyfiles(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "iocs.json").write_text('[{"value": "1.2.3.4", "threat": "a", "confidence": "high", "first_seen": "2025-01-15"}, {"value": "1.2.3.4", "threat": "b"}, {"threat": "none"}]')
    (tmp_path / "kb" / "broken.json").write_text("[{")
    got = logs.known_indicators(spark, str(tmp_path / "kb")).orderBy("nr").collect()
    assert [(r["value"], r["threat"], str(r["reported"])) for r in got] == [("1.2.3.4", "a", "2025-01-15 00:00:00"), ("1.2.3.4", "b", "None")]
    line = "0|{}|12|r/rrw|0|0|99|1|2|3|4\n"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "bodyfile.txt").write_text(line.format("/deep") + "bad line\n")
    assert [r["name"] for r in logs.bodyfile(spark, str(tmp_path)).filter("size is not null").collect()] == ["/deep"]
    (tmp_path / "bodyfile.txt").write_text(line.format("/root"))
    assert [r["name"] for r in logs.bodyfile(spark, str(tmp_path)).collect()] == ["/root"]


def test_scores_of_nothing(spark):
    from logloom.operators import scoring

    rows = spark.createDataFrame([], "event_key string, " + ", ".join(f"{c} double" for c in scoring.FEATURES))
    out = scoring.isolation_scores(rows)
    assert out.count() == 0 and out.columns[-3:] == ["raw_score", "anomaly_score", "is_anomaly"]


def test_broken_files_are_skipped(spark, tmp_path):
    for name, text in (("a", '{"case_id": "a"}'), ("b", "{broken"), ("c", '{"case_id": "c", "job_ids": ["1"]}'), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r["case_id"] for r in logs.stored_cases(spark, str(tmp_path)).collect()) == ["a", "c"]


def test_audit_fields(spark):
    from logloom.functions import parse

    rows = [('a="x y" b=1 b=2 a=z', {"a": "x y", "b": "1"}), ('msg="p=q r" p=s', {"msg": "p=q r", "p": "s"}), ('c="open d=1', {"c": '"open', "d": "1"}), ('e="1" e="2"', {"e": "2"}), ("", {})]
    got = {r["t"]: r["kv"] for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", parse.key_values(F.col("t")).alias("kv")).collect()}
    assert got == dict(rows)


def test_file_records_are_made_once(spark, tmp_path):
    """What makes the file records (a join, say) runs for the first output alone; the others read what it wrote."""
    made = spark.sparkContext.accumulator(0)

    def path(i):
        made.add(1)
        return f"/var/log/{i}"

    files = spark.range(50).select(F.col("id").alias("seq"), F.udf(path, "string")("id").alias("path"), F.lit(1).cast("long").alias("mtime"), F.lit(90_000).cast("long").alias("ctime"), F.lit(5).cast("long").alias("size"), F.lit("p").alias("partition"), F.lit("fs").alias("filesystem"))
    events = bindings.timeline(spark, "/root/testdata/sf0.001").limit(30)
    results.analyse(spark, events, files, str(tmp_path / "out"), "j", score=False)
    assert made.value == 50
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "files.csv")).count() == 50


def test_first_hits_of_a_partition():
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.choice([None, *range(40)]), draw.choice(["date", "Date", "x", "y", "zz"])) for _ in range(700)] + [("c", 5, "x")]
    batches = [pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)), pa.nulls(len(part), pa.timestamp("us", "UTC"))], ["category", "seq", "text", "ts"]) for part in (rows[:9], rows[9:30], rows[30:500], rows[500:])]
    got = [r for b in findings._partial(iter(batches)) for r in b.to_pylist()]
    for c in "abc":
        own = sorted((-(1 << 63) if s is None else s, t) for k, s, t in rows if k == c)
        assert [(r["hit"]["seq"], r["hit"]["text"]) for r in got if r["category"] == c and r["hit"]] == own[: findings.KEPT]
        assert [(r["n"], r["other"]) for r in got if r["category"] == c and not r["hit"]] == [(len(own), sum(t.lower() != "date" for _, t in own))]
