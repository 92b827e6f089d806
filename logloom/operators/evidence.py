"""Where findings come from, and whether evidence is unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.classify import first_of
from logloom.sources.files import register
from logloom.sources.stored import numbered

#: Sources that are logs; the labels of ``location`` are fixed too.
LOG_SOURCES = ["syslog", "logs", "webserver", "audit", "firewall", "journal", "apt", "yum", "mysql", "openvpn", "iptables", "dnf", "mysql_error", "mysql_general", "event_log", "text_log", "wtmp", "sysmon"]


def location(source: Column, meta: dict[str, Column]) -> Column:
    """(file, detail, tool) of where an event was found, by its source."""
    m = lambda k: F.nullif(meta[k].cast("string"), F.lit("")) if k in meta else F.lit(None).cast("string")
    tagged = lambda label, k: F.concat(F.lit(label), m(k))
    detail = lambda otherwise, *parts: F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit(otherwise))
    place = lambda file, d, tool: F.struct(F.coalesce(*file, F.lit("Unbekannt")).alias("file"), d.alias("detail"), tool.alias("tool"))
    disk = source.isin("sleuthkit", "tsk") | m("filesystem").isNotNull() | m("partition").isNotNull()
    fs = F.when(~F.coalesce(m("partition"), F.lit("")).contains(F.coalesce(m("filesystem"), F.lit(""))), tagged("FS: ", "filesystem"))
    return first_of(
        [
            (disk, place((m("name"), m("path")), detail("Dateisystem-Eintrag", tagged("Partition: ", "partition"), tagged("Inode: ", "inode"), fs), F.lit("Sleuth Kit (pytsk3)"))),
            (source == "dissect", place((m("path"), m("name")), F.coalesce(tagged("Dissect-Plugin: ", "plugin"), F.lit("Dissect-Artefakt")), F.lit("dissect.target"))),
            (source.isin(LOG_SOURCES), place((m("source_file"),), detail("Text-Log", tagged("Zeile: ", "line_number"), tagged("Host: ", "hostname")), F.lit("Log-Parser"))),
            (source.startswith("uac"), place((m("path"), m("source_file")), F.coalesce(tagged("UAC-Artefakt: ", "artifact_type"), F.lit("UAC-Artefakt")), F.lit("UAC (Unix Artifact Collector)"))),
        ],
        place((m("name"), m("path"), m("source_file")), F.concat(F.lit("Quelle: "), source), source),
    )


def provenance(anomalies: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row for each anomaly (seq, source, source_file, ...), numbered in the order of ``seq``: place, hash prefixes of its evidence
    file, score, short text. ``hashes`` (file, md5, sha256) are those of the files' contents."""
    meta = {k: F.col(k) for k in ("source_file", "line_number", "hostname", "path") if k in anomalies.columns}
    found = anomalies.withColumn("__at", location(F.col("source"), meta))
    short = lambda c: F.concat(F.left(c, F.lit(16)), F.lit("...")).alias(f"{c}_short")
    side = hashes.select(F.col("file").alias("__file"), short("sha256"), short("md5"))
    out = found.join(side, F.col("source_file") == F.col("__file"), "left")
    none = F.lit("nicht berechnet")
    rows = out.select("seq", F.col("source_file").alias("evidence_file"), F.coalesce("sha256_short", none).alias("sha256_short"), F.coalesce("md5_short", none).alias("md5_short"), F.col("__at.file").alias("found_in_file"), F.col("__at.detail").alias("location_detail"), F.col("__at.tool").alias("extracted_by"), F.bround("anomaly_score", 3).alias("anomaly_score"), "event_type", F.left("description", F.lit(120)).alias("description"))
    return numbered(rows, F.col("seq"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, changed, md5, sha256) of all files below a path, whatever their size."""
    register(spark)
    return spark.read.format("file_digests").load(path)


def dual_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """MD5 and SHA-256 of contents."""
    return files.withColumn("md5", F.md5(content)).withColumn("sha256", F.sha2(content, 256))


def verified(files: DataFrame, expected: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """Whether both hashes are those that were stored; files without stored hashes don't match."""
    side = expected.select(F.col(key).alias("__key"), F.lower("md5").alias("__md5"), F.lower("sha256").alias("__sha256"))
    out = dual_hash(files, content).join(side, F.col(key) == F.col("__key"), "left")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    return out.select(key, same("md5").alias("md5_match"), same("sha256").alias("sha256_match"), (same("md5") & same("sha256")).alias("intact"))


def audit_entry(at: Column, what: Column, **details: Column) -> Column:
    return F.struct(at.alias("timestamp"), what.alias("event"), F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string")))).alias("details"))
