"""Scans of evidence: text logs, bodyfiles, CSV artifacts, login records, knowledge bases and stored cases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import parse
from logloom.functions.classify import first_of
from logloom.sources.files import register


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of text logs: stripped, without blank and '#' lines, numbers counting all lines from 1.

    Files are read in blocks of any size; the lines of each block are counted first, and those of earlier blocks added up.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    line = F.trim(F.regexp_replace("line", "[\r\ufffd]", ""))
    numbered = raw.join(blocks, ["file", "block"]).select("file", (F.col("i") + F.col("shift") + 1).cast("long").alias("line_number"), line.alias("line"))
    return numbered.filter((F.length("line") > 0) & ~F.col("line").startswith("#"))


#: Parts of file names that point to a format, and the pattern that some line of the sample must match.
NAME_HINTS = [
    ("audit", "audit", parse.AUDIT),
    ("apt|dpkg|history", "apt", parse.APT),
    ("yum|dnf", "yum", f"{parse.YUM}|{parse.DNF}"),
    ("mysql|mariadb", "mysql_error", f"{parse.MYSQL_8}|{parse.MYSQL_57}"),
    ("mysql|mariadb", "mysql_general", parse.MYSQL_GENERAL),
    ("openvpn", "openvpn", parse.OPENVPN),
]


def sniffed(lines: DataFrame) -> DataFrame:
    """(file, format): by name where a sample line bears it out, else by the first sample line that any format matches.

    The sample is the first 20 lines among the first 30 of a file.
    """
    near = lines.filter("line_number <= 30")
    nr = F.row_number().over(Window.partitionBy("file").orderBy("line_number"))
    sample = near.withColumn("nr", nr).filter("nr <= 20")
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    hints = [F.max(F.col("line").rlike(f"^(?:{p})$")).alias(f"hint{i}") for i, (_, _, p) in enumerate(NAME_HINTS)]
    first = F.min_by("format", F.when(F.col("format").isNotNull(), F.col("line_number"))).alias("first")
    head = F.max((F.col("nr") == 1) & F.col("line").startswith("{")).alias("json")
    found = sample.withColumn("format", parse.line_format(F.col("line"))).groupBy("file").agg(*hints, first, head)
    rules = [(name.rlike("journal") & F.col("json"), "journal_json"), *((name.rlike(n) & F.col(f"hint{i}"), fmt) for i, (n, fmt, _) in enumerate(NAME_HINTS))]
    return found.select("file", first_of(rules, F.coalesce("first", F.lit("generic"))).alias("format"))


def read_logs(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Events of all text logs under a path: the common fields with file, line_number, raw_line."""
    lines = text_lines(spark, path)
    formats = sniffed(lines)
    out = parse.with_events(lines.join(formats, "file"), parse.any_format(F.col("format")), year=year).filter("e is not null")
    return out.select("file", "line_number", F.col("line").alias("raw_line"), "format", "e.*")


BODYFILE = "md5 string, name string, inode string, mode string, uid int, gid int, size long, atime long, mtime long, ctime long, crtime long"


def bodyfile(spark: SparkSession, path: str) -> DataFrame:
    """Filesystem records of bodyfiles (pipe-separated): of the one in the folder itself, else of all below it. Malformed lines are
    dropped."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bodyfile.txt")
    own = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    reader = spark.read.schema(BODYFILE).option("sep", "|").option("mode", "DROPMALFORMED")
    rows = reader.csv(f"{path}/bodyfile.txt") if own else reader.option("pathGlobFilter", "bodyfile*.txt").option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("source", F.lit("uac_bodyfile"))


def artifact_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source, file, fields) of the rows of all artifact tables below a path, each by the header of its own file, as a map.

    One plan for any number of files: the first line of each is its header, and rows are read with as many columns as the widest
    header. Names that are missing or that repeat get a number; rows with more fields than their header are dropped, and what a
    row lacks is null. Files without a line add nothing.
    """
    own = {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}
    lines = spark.read.options(**own).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    heads = lines.filter((F.col("block") == 0) & (F.trim("line") != "")).groupBy("file").agg(F.min_by("line", "i").alias("line"))
    width = heads.agg(F.max(F.length("line") - F.length(F.replace("line", F.lit(","))))).first()[0]
    if width is None:
        return spark.createDataFrame([], "source string, file string, fields map<string,string>")
    names = [f"c{i}" for i in range(width + 2)]  # one more than the widest header has
    schema = ", ".join(f"{c} string" for c in names)
    given = F.from_csv("line", schema)
    header = F.array(*(given[c] for c in names))
    used = F.size(F.split(F.regexp_replace("line", r'"[^"]*"', "q"), ","))
    titles = F.transform(F.slice(header, 1, used), lambda t, i: F.coalesce(F.nullif(F.trim(t), F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string"))))
    earlier = lambda i: F.size(F.filter(F.slice("titles", 1, i), lambda x: x == F.element_at("titles", i + 1)))
    unique = F.transform("titles", lambda t, i: F.when(earlier(i) > 0, F.concat(t, F.lit("."), earlier(i).cast("string"))).otherwise(t))
    heads = heads.select("file", titles.alias("titles")).select(F.col("file").alias("__file"), unique.alias("titles"))
    rows = spark.read.schema(schema).options(**own, header="true").csv(path).select(F.col("_metadata.file_path").alias("file"), F.array(*names).alias("cells"))
    n = F.size("titles")
    fit = rows.join(heads, F.col("file") == F.col("__file")).filter(~F.exists(F.slice("cells", n + 1, F.size("cells")), lambda c: c.isNotNull()))
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"\.csv$", "")
    return fit.select(F.concat(F.lit("uac_artifacts/"), stem).alias("source"), "file", F.map_from_arrays("titles", F.slice("cells", 1, n)).alias("fields"))


def read_logins(spark: SparkSession, path: str) -> DataFrame:
    """Events of login files (see ``files.LoginRecords``), of any size: tasks read ranges of records."""
    register(spark)
    own = spark.read.format("login_records").load(path)
    ip = F.nullif(F.regexp_extract("hostname", r"^(\d+\.\d+\.\d+\.\d+)", 1), F.lit(""))
    return own.select("file", F.timestamp_seconds("seconds").alias("ts"), "event_type", "user", "terminal", "hostname", ip.alias("src_ip"), "pid", F.col("nr").alias("line_number"))


def sysmon_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines with sysmon XML and their event: id, image, command line, addresses. Broken XML gives null fields."""
    import xml.etree.ElementTree as ET

    from logloom.functions import classify

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = ["Image", "CommandLine", "User", "DestinationIp", "DestinationPort", "TargetFilename", "QueryName", "ParentImage"]
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("__xml")).to_pylist():
                own: dict[str, str | None] = {}
                try:
                    for node in ET.fromstring(text or "").iter():
                        tag = node.tag.rpartition("}")[2]
                        if tag == "EventID":
                            own["EventID"] = node.text
                        elif tag == "Data" and node.get("Name"):
                            own[node.get("Name")] = node.text
                except ET.ParseError:
                    own = {}
                rows.append(own)
            extra = [pa.array([r.get(k) for r in rows], pa.string()) for k in ["EventID", *wanted]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *extra], [*batch.schema.names, "event_id", *wanted])

    own = lines.withColumn("__xml", F.nullif(F.regexp_extract(column, r"(?s)(<Event[ >].*</Event>)", 1), F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", event_id string, Image string, CommandLine string, User string, DestinationIp string, DestinationPort string, TargetFilename string, QueryName string, ParentImage string"
    out = own.mapInArrow(decode, schema).drop("__xml")
    return out.withColumn("event_type", classify.sysmon(F.col("event_id").try_cast("int"), F.col("Image"), F.col("CommandLine"), F.col("DestinationPort")))


def input_type(name: Column, is_dir: Column | None = None) -> Column:
    """What an input is, by its name."""
    n = F.lower(name)
    ends = lambda *s: n.rlike(r"\.(" + "|".join(s) + ")$")
    rules = [(ends("dd", "raw", "img", "e01", "ex01", "vmdk", "vdi", "qcow2", "001"), "disk_image"), (ends("evtx"), "evtx"), (n.contains("audit"), "audit_log"), (ends("journal"), "journal_log"), (ends("zip", "tar", "tgz", "gz", "7z"), "archive")]
    return first_of([*([(is_dir, "uac_dump")] if is_dir is not None else []), *rules], "logs")


def stored_cases(spark: SparkSession, path: str) -> DataFrame:
    """Stored cases, the last changed file first."""
    return json_rows(spark, path, CASE).orderBy(F.desc("_modified"), "_file")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Knowledge bases, cases and other JSON files, a row for each object; broken files are skipped. Has ``_file`` and ``_modified``."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"))


def known_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Entries of indicator files (see IOC_KB) with ``nr``, their order, and ``reported``, the time that ``first_seen`` names: what
    ``indicators.looked_up`` takes. Broken files, and entries without a value, are skipped."""
    own = json_rows(spark, path, IOC_KB).filter("value is not null")
    return own.withColumn("nr", F.monotonically_increasing_id()).withColumn("reported", parse.any_time(F.col("first_seen")))


IOC_KB = "value string, type string, threat string, source string, confidence string, first_seen string, tags array<string>"
SIGNATURE_KB = "name string, pattern string, severity string, description string, recommendation string"
CASE = "case_id string, name string, case_number string, description string, analyst string, job_ids array<string>, created_at string, updated_at string"

#: Numbers of file systems and their names.
FILE_SYSTEMS = {1: "ntfs", 2: "fat12", 4: "fat16", 8: "fat32", 10: "exfat", 16: "ufs", 128: "ext2", 256: "ext3", 2048: "iso9660", 4096: "hfs", 8192: "ext4", 65536: "apfs"}


def file_system(number: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in FILE_SYSTEMS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.concat(F.lit("unbekannt("), number.cast("string"), F.lit(")")))


#: First bytes of files that settle what they are, endings of names, and first bytes of media types.
MAGIC = [("455646", "disk_image"), ("23204469736B2044657363726970746F7246696C65", "disk_image")]
ENDINGS = {
    "disk_image": ["dd", "raw", "img", "001", "e01", "ex01", "ewf", "aff", "afd", "vdi", "vmdk", "vhd", "vhdx", "qcow", "qcow2", "iso"],
    "logs": ["log", "txt", "syslog", "auth", "messages", "evtx", "evt"],
    "archive": ["zip", "tar", "gz", "bz2", "7z", "rar", "tgz"],
}
MEDIA = [("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"), ("377ABCAF271C", "application/x-7z-compressed"), ("FD377A585A00", "application/x-xz-compressed"), ("52617221", "application/x-rar-compressed"), ("25504446", "application/pdf"), ("89504E47", "image/png"), ("7F454C46", "application/x-executable"), ("456C6646696C6500", "application/x-ms-evtx")]
#: Names within a folder that show a dump of live artifacts.
DUMP_NAMES = ["bodyfile.txt", "live_response", "artifacts"]
LARGE, SMALL = 1_000_000_000, 10_000_000


def _ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def detected(spark: SparkSession, path: str) -> DataFrame:
    """File info rows (path, name, size, modified, extension, mime_type, type) of all files below a path, of which the first 512
    bytes are read: by first bytes, then by the ending of the name, then by media type, then by size: beyond a gigabyte and
    mostly outside printable ASCII a disk image, below 10 MB and UTF-8 a log."""
    register(spark)
    files = spark.read.format("file_heads").load(path).withColumn("name", F.element_at(F.split("file", "/"), -1))
    head, ending = F.hex("head"), _ending(F.col("name"))
    magic = first_of([(head.startswith(m), t) for m, t in MAGIC], F.lit(None).cast("string"))
    by_name = first_of([(ending.isin(e), t) for t, e in ENDINGS.items()], F.lit(None).cast("string"))
    # a character may be cut off at the end of what is read
    plain = F.exists(F.array(*(F.substring("head", 1, F.octet_length("head") - cut) for cut in range(4))), lambda h: F.is_valid_utf8(h.cast("string"))) & ~F.contains(F.col("head"), F.lit(b"\0"))
    tar = F.substring("head", 258, 5) == F.lit(b"ustar")
    media = first_of([*((head.startswith(m), t) for m, t in MEDIA), (tar, "application/x-tar"), (F.octet_length("head") == 0, "inode/x-empty"), (plain, "text/plain")], "application/octet-stream")
    by_media = first_of([(F.col("mime_type").contains("text"), "logs"), (F.col("mime_type").rlike("compressed|zip|tar"), "archive")], F.lit(None).cast("string"))
    binary = F.length(F.regexp_replace(head, "(?:[2-6][0-9A-F]|7[0-9A-F])(?=(?:..)*$)", "")) / F.length(head) > 0.5
    by_size = first_of([((F.col("size") > LARGE) & binary, "disk_image"), ((F.col("size") < SMALL) & plain, "logs")], "unknown")
    out = files.withColumn("mime_type", media)
    return out.select(F.col("file").alias("path"), "name", "size", F.timestamp_micros((F.col("changed") * 1_000_000).cast("long")).alias("modified"), ending.alias("extension"), "mime_type", F.coalesce(magic, by_name, by_media, by_size).alias("type"))


def detected_folders(spark: SparkSession, path: str) -> DataFrame:
    """(path, type) of each folder below a path that holds anything: a dump by the names in it, logs where all files in it end like
    logs, else unknown. ``path`` itself is among them."""
    register(spark)
    root = path.rstrip("/")
    names = spark.read.format("file_heads").load(path).select(F.split(F.substring(F.col("file"), F.locate(root.rpartition(":")[2], F.col("file")) + len(root.rpartition(":")[2]) + 1, 1 << 30), "/").alias("parts"))
    place = names.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    held = place.select(F.concat_ws("/", F.lit(root), F.slice("parts", 1, F.col("depth") - 1)).alias("path"), F.element_at("parts", F.col("depth")).alias("name"), (F.col("depth") == F.size("parts")).alias("is_file"))
    shape = held.groupBy("path").agg(F.bool_or(F.col("name").isin(DUMP_NAMES)).alias("dump"), F.bool_and(~F.col("is_file") | _ending(F.col("name")).isin(ENDINGS["logs"])).alias("logs"))
    return shape.select("path", first_of([(F.col("dump"), "uac_dump"), (F.col("logs"), "logs")], "unknown").alias("type"))
