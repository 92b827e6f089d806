"""Scans of evidence on small files that are written here, and what has no SQL to compare with."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions import parse
from logloom.operators import findings, scoring
from logloom.sources import logs
from logloom.streaming.events import hourly_stream


def test_text_lines_over_blocks(spark, tmp_path):
    for name, n in (("auth.log", 500), ("other.txt", 3)):
        (tmp_path / name).write_text("".join(f"Jan  5 10:00:{i % 60:02d} h sshd[{i}]: Accepted password for u{i}\r\n" if i % 3 else "# note\n\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    got = sorted((r["file"].rpartition("/")[2], r["line_number"], r["line"]) for r in logs.text_lines(spark, str(tmp_path)).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(p.name, i, x.strip()) for p in tmp_path.iterdir() for i, x in enumerate(p.read_text().split("\n"), 1) if x.strip() and not x.startswith("#")]
    assert got == sorted(want)


def test_read_logs_by_format(spark, tmp_path):
    (tmp_path / "auth.log").write_text("Jan  5 10:00:00 gw sshd[7]: Failed password for root from 1.2.3.4 port 22\nnothing known here\n")
    (tmp_path / "yum.log").write_text("2025-01-15T08:00:01Z INFO Installed: nmap\n")
    (tmp_path / "access.log").write_text('1.1.1.1 - - [15/Jan/2025:08:00:01 +0000] "GET /a?x=1%20union+select HTTP/1.1" 200 5\n')
    got = {(r["file"].rpartition("/")[2], r["line_number"]): (r["format"], r["event_type"]) for r in logs.read_logs(spark, str(tmp_path), 2025).collect()}
    assert got == {("auth.log", 1): ("syslog", "auth_failure"), ("auth.log", 2): ("syslog", "log_entry"), ("yum.log", 1): ("yum", "package_install"), ("access.log", 1): ("apache_combined", "sqli_attempt")}


def test_one_pattern_is_applied_once(spark):
    plan = parse.with_events(spark.createDataFrame([("x",)], "line string"), parse.syslog, year=2025).filter("e.event_type = 'auth_failure'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4  # in the condition and the value of either form, which Spark computes once


def test_bodyfile_and_artifacts(spark, tmp_path):
    (tmp_path / "bodyfile.txt").write_text("0|/etc/passwd|12|r/rrw|0|0|99|1|2|3|4\n")
    assert [(r["name"], r["size"], r["mtime"], r["source"]) for r in logs.bodyfile(spark, str(tmp_path)).collect()] == [("/etc/passwd", 99, 2, "uac_bodyfile")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "ps.csv").write_text("pid,name\n1,init\n")
    (tmp_path / "net.csv").write_text("name,port,state\nsshd,22,up\n")
    got = sorted((r["source"], tuple(sorted(r["fields"].items()))) for r in logs.artifact_csv(spark, str(tmp_path)).collect())
    assert got == [("uac_artifacts/net", (("name", "sshd"), ("port", "22"), ("state", "up"))), ("uac_artifacts/ps", (("name", "init"), ("pid", "1")))]
    (tmp_path / "none").mkdir()
    assert logs.artifact_csv(spark, str(tmp_path / "none")).count() == 0


def test_logins(spark, tmp_path):
    record = lambda kind, user, at: struct.pack("<h2xi32s4s32s256shhiii4i20s", kind, 1, b"pts/0", b"", user, b"10.1.2.3", 0, 0, 0, at, 0, 0, 0, 0, 0, b"")
    (tmp_path / "wtmp").write_bytes(record(7, b"root", 1_700_000_000) + record(8, b"root", 1_700_000_100) + record(1, b"", 5) + b"cut")
    (tmp_path / "btmp").write_bytes(record(7, b"eve", 1_700_000_050))
    got = sorted((r["file"].rpartition("/")[2], r["event_type"], r["user"], r["src_ip"]) for r in logs.read_logins(spark, str(tmp_path)).collect())
    assert got == [("btmp", "auth_failure", "eve", "10.1.2.3"), ("wtmp", "auth_success", "root", "10.1.2.3"), ("wtmp", "session_closed", "root", "10.1.2.3")]


def test_stored_cases_and_detection(spark, tmp_path):
    import os

    for i, name in enumerate(("a", "b")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"case_id": name, "job_ids": ["1"]}))
        os.utime(tmp_path / f"{name}.json", (1_000_000 + i, 1_000_000 + i))
    (tmp_path / "c.json").write_text("{broken")
    assert [r["case_id"] for r in logs.stored_cases(spark, f"{tmp_path}/*.json").collect() if r["case_id"]] == ["b", "a"]
    (tmp_path / "x").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "y").write_text("some text")
    (tmp_path / "z").write_bytes(b"\xff\xfe\x00\x80")
    got = {r["path"].rpartition("/")[2]: r["type"] for r in logs.detected(spark, str(tmp_path)).collect()}
    assert (got["x"], got["y"], got["z"]) == ("archive", "logs", "unknown")


def test_forest_against_plain_paths(spark):
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(300, 3))
    forest = scoring.Forest(sample, trees=20, size=64)
    feature, split, left, right, height = forest.nodes

    def depth(x, at):
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] < split[at] else right[at]
        return height[at]

    points = rng.normal(size=(50, 3)) * 3
    want = [-(2.0 ** (-np.mean([depth(x, r) for r in forest.roots]) / scoring.average_path(64))) for x in points]
    assert np.allclose(forest.score(points), want)
    rows = spark.createDataFrame([(f"k{i}", *([float(i % 5)] * 8)) for i in range(99)] + [("odd", *([1e4] * 8))], "event_key string, " + ", ".join(f"{c} double" for c in scoring.FEATURES))
    best = scoring.isolation_scores(rows).orderBy(F.desc("anomaly_score")).first()
    assert (best["event_key"], best["anomaly_score"], best["is_anomaly"]) == ("odd", 1.0, True)


def test_all_findings_and_gate(spark):
    events = spark.createDataFrame([(i, f"2025-01-01 00:{i:02d}:00", "shred -u x" if i == 3 else "plain", "") for i in range(30)], "seq long, t string, description string, path string").withColumn("ts", F.to_timestamp("t"))
    files = spark.createDataFrame([(1, "/var/log/a", 10, 200_000, 0)], "seq long, path string, mtime long, ctime long, size long")
    assert sorted(r["category"] for r in findings.all_findings(events, files).collect()) == ["timestomping", "truncated_logs", "wipe_tools"]
    assert findings.log_gaps(events.limit(5), hours=0).count() == 0


def test_stream_counts_each_event_once(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01 10:05:00", "a", "x"), ("2025-01-01 10:05:00", "a", "x"), ("2025-01-01 10:40:00", "a", "y"), ("2025-01-01 11:00:00", "b", "x")], "t string, event_type string, description string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    from logloom.streaming.events import event_stream

    query = hourly_stream(event_stream(spark, str(tmp_path / "in"), "event_type string, description string, ts timestamp")).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["hour"].hour, r["event_type"], r["n"]) for r in spark.table("hours").collect()) == [(10, "a", 2), (11, "b", 1)]


@pytest.mark.parametrize("name", list(parse.PARSERS))
def test_steps_and_one_expression_agree(spark, name):
    own = ["Jan  5 10:00:00 gw sshd[7]: Accepted x", "2025-01-15T08:00:01Z INFO Installed: nmap", "type=EXECVE msg=audit(1.0:2): argc=2 a0=\"bash\" a1=-i", "{\"MESSAGE\": \"oom\", \"_COMM\": \"kernel\"}", "2025-01-01 00:00:00|AUTH|s|m|h|u", ""]
    lines = spark.createDataFrame([(x,) for x in [*own, None]], "line string")
    staged = parse.with_events(lines, parse.PARSERS[name], year=2025).select("line", F.to_json("e").alias("e"))
    whole = lines.select("line", F.to_json(parse.event_of(parse.PARSERS[name], F.col("line"), 2025)).alias("e"))
    assert sorted(map(str, staged.collect())) == sorted(map(str, whole.collect()))
