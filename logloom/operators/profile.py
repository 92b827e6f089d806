"""What kind of system the events come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import tables as T
from logloom.functions.classify import first_of, has
from logloom.operators.normalize import field


def os_vote(files: DataFrame) -> DataFrame:
    """Different paths that point to each system, and the one with most (ties: linux, windows, macos; none: unknown)."""
    votes = {o: F.count_distinct(F.when(has(F.col("path"), *p), F.col("path"))) for o, p in T.OS_PATHS.items()}
    some = files.filter(has(F.col("path"), *(p for own in T.OS_PATHS.values() for p in own)))  # so that few rows are told apart
    out = some.agg(*(v.alias(o) for o, v in votes.items()))
    most = F.greatest("linux", "windows", "macos")
    return out.withColumn("os_type", first_of([(most == 0, "unknown"), (F.col("linux") == most, "linux"), (F.col("windows") == most, "windows")], "macos"))


def distribution(events: DataFrame, files: DataFrame) -> DataFrame:
    """By the first message that names a distribution and its version, else by paths."""
    p = F.lower("path")
    by_path = [(has(F.col("path"), "/etc/debian_version") | has(p, "apt"), "Debian/Ubuntu"), (has(F.col("path"), "/etc/redhat-release", "/etc/centos-release") | has(p, "yum", "dnf"), "RHEL/CentOS/Fedora"), (has(F.col("path"), "/etc/arch-release") | has(p, "pacman"), "Arch Linux"), (has(F.col("path"), "/etc/alpine-release") | has(p, "apk"), "Alpine Linux")]
    seen = files.agg(*(F.coalesce(F.bool_or(w), F.lit(False)).alias(f"p{i}") for i, (w, _) in enumerate(by_path)))
    m = F.col("description")
    named = F.when(m.rlike(T.DEBIAN), F.struct(F.regexp_extract(m, T.DEBIAN, 1).alias("d"), F.regexp_extract(m, T.DEBIAN, 2).alias("v"))).when(m.rlike(T.RHEL), F.struct(F.regexp_extract(m, T.RHEL, 1).alias("d"), F.regexp_extract(m, T.RHEL, 2).alias("v")))
    first = events.withColumn("__n", named).filter("__n is not null").agg(F.min_by("__n", "seq").alias("n"))
    both = seen.join(F.broadcast(first))
    path_name = first_of([(F.col(f"p{i}"), d) for i, (_, d) in enumerate(by_path)], F.lit(None).cast("string"))
    return both.select(F.coalesce("n.d", path_name).alias("distribution"), F.col("n.v").alias("version"))


def hostname(events: DataFrame) -> DataFrame:
    """The most frequent host name (ties: the least) and its count."""
    counts = events.filter(F.col("hostname").isNotNull() & ~F.col("hostname").isin("localhost", "127.0.0.1", "-", "")).groupBy("hostname").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "hostname").limit(1)


def kernel(events: DataFrame) -> DataFrame:
    found = F.nullif(F.regexp_extract("description", T.KERNEL, 1), F.lit(""))
    return events.select("seq", found.alias("kernel")).filter("kernel is not null").agg(F.min_by("kernel", "seq").alias("kernel"))


def users(events: DataFrame, n: int = 20) -> DataFrame:
    counts = events.filter(F.col("user").isNotNull() & ~F.col("user").isin(T.SYSTEM_USERS)).groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "user").limit(n)


def packages(events: DataFrame, n: int = 100) -> DataFrame:
    """The last action on each package, in the order of their first appearance."""
    own = events.select("seq", field(events, "package").alias("package"), field(events, "action").alias("action")).filter("package is not null")
    by = own.groupBy("package").agg(F.max_by("action", "seq").alias("action"), F.min("seq").alias("first_seq"))
    return by.orderBy("first_seq", "package").limit(n)


def services(events: DataFrame, n: int = 50) -> DataFrame:
    kinds = events.filter(F.col("event_type").isin("service_event", "persistence_mechanism") & F.col("unit").isNotNull())
    return kinds.groupBy("unit").agg(F.max_by("event_type", "seq").alias("event_type"), F.min("seq").alias("first_seq")).orderBy("first_seq", "unit").limit(n)


def addresses(events: DataFrame, n: int = 20) -> DataFrame:
    ips = events.select(F.explode(F.regexp_extract_all("description", F.lit(T.IPV4), F.lit(0))).alias("ip"))
    counts = ips.filter(~F.col("ip").startswith("127.") & ~F.col("ip").startswith("0.")).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "ip").limit(n)


def suspicious_dirs(files: DataFrame, n: int = 30) -> DataFrame:
    return files.filter(has(F.col("path"), *T.DROP_DIRS)).select("path").distinct().orderBy("path").limit(n)


def system_profile(events: DataFrame, files: DataFrame) -> DataFrame:
    """One row of all the above with a confidence by how much is known."""
    gather = lambda df, c, out: df.agg(F.array_sort(F.collect_list(c)).alias(out))
    one = os_vote(files).select("os_type")
    host = events.sparkSession.range(1).select().join(hostname(events).select("hostname"), F.lit(True), "left")
    parts = [distribution(events, files), host, kernel(events), gather(users(events), "user", "users"), gather(packages(events), "package", "packages"), gather(addresses(events), "ip", "network_ips"), gather(suspicious_dirs(files), "path", "suspicious_dirs")]
    for p in parts:
        one = one.join(F.broadcast(p))  # a row each
    points = [(F.col("os_type") != "unknown", 2), (F.col("hostname").isNotNull(), 1), (F.col("kernel").isNotNull(), 2), (F.size("users") > 0, 1), (F.col("distribution").isNotNull(), 1), (F.size("packages") > 0, 1)]
    score = sum((F.when(w, n).otherwise(0) for w, n in points), F.lit(0))
    return one.withColumn("confidence", first_of([(score >= 6, "high"), (score >= 3, "medium")], "low"))

