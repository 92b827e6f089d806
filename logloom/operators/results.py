"""What an analysis leaves behind: its tables, written by Spark's writers under a folder of the job, and read back.

Each job's results replace what it left before, but for job records, audit entries and stage times, which are appended.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import classify
from logloom.operators import attack, evidence, findings, indicators, normalize, profile, scoring, views
from logloom.operators.store import read_results, write_result

#: Types whose anomalies tell of an attacker's infrastructure, whatever their tactics.
INFRA_TYPES = ["c2_beacon", "c2_tool", "vpn_connection", "dns_query", "network_connect", "suspicious_tool_installed", "file_download", "ssh_event", "data_exfiltration"]


def append(df: DataFrame, path: str) -> None:
    """Job records, audit entries and stage times: new rows, never changed ones."""
    df.write.mode("append").json(path)


def selected(events: DataFrame, focus: str = "suspicious", n: int = 1000) -> DataFrame:
    """The events that a prompt shows: suspicious ones or all in their order, or the most recent ones."""
    own = events
    if focus == "suspicious":
        own = events.filter(classify.suspicious(F.col("event_type"), F.col("is_anomaly"), F.col("anomaly_score"), F.col("description")))
    order = [F.desc_nulls_last("ts"), F.col("seq")] if focus == "recent" else [F.col("seq")]
    return own.orderBy(*order).limit(n).select("seq", "ts", F.col("event_type").alias("type"), "description")


def infra_or_all(anomalies: DataFrame) -> DataFrame:
    """The anomalies of an attacker's infrastructure, or all where there are none of them."""
    marked = attack.enriched(anomalies).withColumn("__infra", F.col("event_type").isin(INFRA_TYPES) | F.col("is_attacker_infra"))
    some = marked.agg(F.coalesce(F.bool_or("__infra"), F.lit(False)).alias("__some"))
    return marked.join(F.broadcast(some)).filter(F.col("__infra") | ~F.col("__some")).drop("__infra", "__some")


def infra_indicators(anomalies: DataFrame) -> DataFrame:
    """(category, value) of an attacker's infrastructure: the first 30 addresses, 20 names and 20 tools by value."""
    own = infra_or_all(anomalies)
    found = indicators.extracted(own).filter(F.col("category").isin("ips", "domains", "processes") & ~F.col("value").startswith("127."))
    return views.indicator_list(found, 30).filter((F.col("category") == "ips") | (F.col("nr") <= 20)).select("category", "value")


def infra_panel(anomalies: DataFrame) -> DataFrame:
    """(category, nr, value) of an attacker's infrastructure, in the order of first appearance: 30 addresses, source and destination
    ones, 20 names that were looked up, 20 tools that were installed."""
    own = attack.enriched(anomalies).filter(F.col("event_type").isin(INFRA_TYPES) | F.col("is_attacker_infra"))
    f = lambda name: normalize.field(own, name)
    asked = F.coalesce(f("query_name"), F.nullif(F.regexp_extract(F.coalesce(f("message"), f("description")), "fragt '([^']+)'", 1), F.lit("")))
    at = lambda category, place, value: F.struct(F.lit(category).alias("category"), F.lit(place).alias("place"), value.alias("value"))
    address = lambda ip: F.when(~ip.startswith("127.") & ~ip.isin("::1", ""), ip)
    kinds = F.array(at("ips", 0, address(f("src_ip"))), at("ips", 1, address(f("dst_ip"))), at("domains", 0, F.when(F.col("event_type") == "dns_query", asked)), at("tools", 0, F.when(F.col("event_type") == "suspicious_tool_installed", F.nullif(f("package"), F.lit("")))))
    first = own.select("seq", F.explode(kinds).alias("k")).filter("k.value is not null").groupBy("k.category", "k.value").agg(F.min(F.struct("seq", "k.place")).alias("first"))
    nr = F.row_number().over(Window.partitionBy("category").orderBy("first", "value"))
    return first.withColumn("nr", nr).filter(F.col("nr") <= F.when(F.col("category") == "ips", 30).otherwise(20)).select("category", F.col("nr").cast("long").alias("nr"), "value")


def prompt_sections(events: DataFrame, n_events: int = 100, n_values: int = 10) -> DataFrame:
    """(section, nr, line) of a prompt: the first suspicious events, and the first indicators of each category."""
    picked = selected(events, n=n_events)
    rows = picked.select(F.lit("events").alias("section"), F.col("seq").alias("nr"), F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "type", "description").alias("line"))
    found = views.indicator_list(indicators.extracted(events), n_values)
    return rows.unionByName(found.select(F.col("category").alias("section"), F.col("nr").cast("long").alias("nr"), F.col("value").alias("line")))


def tampering(found: DataFrame) -> DataFrame:
    """One row: the risk of the findings, its level and sentence, and the findings themselves, the gravest first."""
    grave = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = found.agg(F.array_sort(F.collect_list(F.struct(grave.alias("__grave"), "category", "severity", "n_hits", "technique", "evidence"))).alias("f"))  # as many as checks
    bare = F.transform("f", lambda x: F.struct(*(x[c].alias(c) for c in ("category", "severity", "n_hits", "technique", "evidence"))))
    return findings.risk(found).join(F.broadcast(rows)).withColumn("findings", bare).drop("f")


def analyse(spark: SparkSession, events: DataFrame, files: DataFrame, out_dir: str, job_id: str, score: bool = True, evidence_dir: str | None = None) -> None:
    """All stages over normalized ``events`` and ``files``, each written under ``out_dir``: what follows reads what was written.

    Leaves normalized and files (Parquet), timeline.csv, files.csv, system_profile, findings, tampering, anomalies, selection, provenance,
    indicators, digests, summary, each a table partitioned by job of which the job's own partition is replaced, and appends to jobs,
    audit and stage_times. With ``score`` unset, events bring their own anomaly_score and is_anomaly. Events name their
    ``source_file`` by the path below ``evidence_dir``; without that folder no digests are known.
    """
    took: list[tuple[str, str, float]] = []
    put = lambda df, name, form="json": write_result(df, out_dir, name, job_id, form)
    get = lambda df, name, form="parquet": read_results(spark, out_dir, name, _ddl(df), [job_id], form).drop("job_id")

    def stage(name: str, run: Callable[[], None]) -> None:
        began = time.time()
        run()
        took.append((job_id, name, round(time.time() - began, 3)))

    audit(spark, out_dir, "analysis_started", job_id=job_id)
    if score:
        events = scoring.isolation_scores(scoring.features(events.drop("anomaly_score", "is_anomaly")))
    stage("normalized", lambda: put(events, "normalized", "parquet"))
    events = get(events, "normalized")
    stage("timeline", lambda: put(events, "timeline.csv", "csv"))


    def write_files() -> None:
        put(files, "files", "parquet")
        put(get(files, "files"), "files.csv", "csv")

    stage("files", write_files)
    files = get(files, "files")
    stage("system_profile", lambda: put(profile.system_profile(events, files), "system_profile"))
    found = findings.all_findings(events, files)
    stage("findings", lambda: put(found, "findings", "parquet"))
    found = get(found, "findings")
    put(tampering(found), "tampering")
    anomalies = attack.enriched(events.filter("is_anomaly")).withColumn("explanation", scoring.explanation())
    stage("anomalies", lambda: put(anomalies, "anomalies"))
    stage("selection", lambda: put(selected(events), "selection"))
    stage("indicators", lambda: put(indicators.extracted(events), "indicators"))
    hashes = spark.createDataFrame([], "file string, size long, changed double, md5 string, sha256 string")
    if evidence_dir:
        below = F.substring_index(F.col("file"), evidence_dir.rstrip("/").rpartition("/")[2] + "/", -1)
        hashes = evidence.digests(spark, evidence_dir).withColumn("file", below)
    put(hashes, "digests")
    hashes = get(hashes, "digests", "json")
    missing = {c: F.lit(None).cast(t) for c, t in (("source_file", "string"), ("line_number", "long")) if c not in events.columns}
    stage("provenance", lambda: put(evidence.provenance(events.filter("is_anomaly").withColumns(missing), hashes), "provenance"))
    counts = events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_anomaly").alias("n_anomalies"), F.round(F.max("anomaly_score"), 3).alias("top_score"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    summary = counts.join(F.broadcast(findings.risk(found)))
    files_of = hashes.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("evidence_bytes"), F.max(F.when(F.col("file").isNotNull(), F.struct("md5", "sha256"))).alias("__one"))
    one = lambda c: F.when(F.col("n_files") == 1, F.col(f"__one.{c}")).alias(f"{c}_hash")  # noqa: E731  of one evidence file, as its own
    summary = summary.join(F.broadcast(files_of)).select(*summary.columns, "n_files", "evidence_bytes", one("md5"), one("sha256"))
    stage("summary", lambda: put(summary, "summary"))
    append(spark.createDataFrame([(job_id, "done")], "job_id string, status string").withColumn("finished", F.current_timestamp()), f"{out_dir}/jobs")
    append(spark.createDataFrame(took, "job_id string, stage string, seconds double"), f"{out_dir}/stage_times")
    audit(spark, out_dir, "analysis_completed", job_id=job_id, stages=str(len(took)))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def audit(spark: SparkSession, out_dir: str, what: str, **details: str) -> None:
    """Appends an entry (timestamp, event, details) to the audit log below ``out_dir``; entries are never changed."""
    entry = evidence.audit_entry(F.current_timestamp(), F.lit(what), **{k: F.lit(v) for k, v in details.items()})
    append(spark.range(1).select(entry.alias("e")).select("e.*"), f"{out_dir}/audit")


ANOMALY = "seq long, event_type string, description string, hostname string, anomaly_score double"


def read_jobs(spark: SparkSession, out_dir: str, jobs: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, anomalies, indicators) of all jobs or of some, each row with its job_id: one scan of each kind, of the partitions
    of those jobs; a job without one of them adds none."""
    kinds = {"summary": "n_events long, n_anomalies long, top_score double, risk_score long, risk_level string", "anomalies": ANOMALY, "indicators": "category string, value string"}
    return tuple(read_results(spark, out_dir, name, schema, jobs, "json") for name, schema in kinds.items())


def keyword_techniques(text, words: dict[str, tuple[str, str, str]]):
    """Techniques that keywords of a text point to, in the order of the keywords: {keyword: (id, name, tactic)}."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = lambda t: F.struct(F.lit(t[0]).alias("id"), F.lit(t[1]).alias("name"), F.lit(t[2]).alias("tactic"))
    return F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(w), one(t)) for w, t in words.items()))))
