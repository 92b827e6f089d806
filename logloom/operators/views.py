"""Queries of the interactive views and reports: buckets, filters, pages, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import tables as T
from logloom.functions.classify import first_of, is_external, risk_level

IP_AFTER = r"(?:from|to)\s+(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def hourly(events: DataFrame) -> DataFrame:
    return events.filter("ts is not null").groupBy(F.date_trunc("HOUR", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("n_anomalies"))


def scatter(events: DataFrame) -> DataFrame:
    """Each anomaly with the number of events in its hour."""
    hours = hourly(events).select(F.col("hour").alias("__hour"), F.col("n").alias("n_hour"))
    own = events.filter(F.col("is_anomaly") & F.col("ts").isNotNull())
    return own.join(hours, F.date_trunc("HOUR", "ts") == F.col("__hour"), "left").select("seq", F.coalesce("n_hour", F.lit(0)).alias("n_hour"), F.round(F.col("anomaly_score") * 100, 1).alias("percent"))


def phases(events: DataFrame) -> DataFrame:
    of = F.create_map(*(F.lit(x) for kv in T.PHASES.items() for x in kv))
    return events.select("event_type").distinct().select(F.try_element_at(of, F.upper("event_type")).alias("phase")).filter("phase is not null").distinct()


def external_ips(events: DataFrame, n: int = 8) -> DataFrame:
    ip = F.nullif(F.regexp_extract("description", IP_AFTER, 1), F.lit(""))
    own = events.select(ip.alias("ip"), "anomaly_score").filter("ip is not null").filter(is_external(F.col("ip")))
    by = own.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"))
    return by.orderBy(F.desc("max_score"), F.desc("n"), "ip").limit(n)


def summary_bar(events: DataFrame) -> DataFrame:
    ip = F.nullif(F.regexp_extract("description", IP_AFTER, 1), F.lit(""))
    top = F.max_by(F.date_trunc("HOUR", "ts"), F.struct("anomaly_score", -F.col("seq")))
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(is_external(ip), ip)).alias("n_external"), F.count_if(F.col("anomaly_score") >= 0.8).alias("n_critical"), F.max("anomaly_score").alias("top_score"), top.alias("top_hour"))


def top_by_score(events: DataFrame, n: int, least: float | None = None) -> DataFrame:
    own = events if least is None else events.filter(F.col("anomaly_score") >= least)
    return own.orderBy(F.desc_nulls_last("anomaly_score"), "seq").limit(n)


def event_page(events: DataFrame, text: str = "", sort: str = "ts", descending: bool = False, page: int = 0, size: int = 25, after: tuple | None = None) -> DataFrame:
    """A page of events that hold a text, sorted by any column, nulls last both ways; texts in the order of a dictionary.

    ``after`` is (value of the sort column, seq) of the last event of the page before: what follows is found by a filter, so any
    page costs what the first one does. Without it, ``page`` pages are passed over.
    """
    holds = F.concat_ws(" ", "description", "event_type", "source", F.col("seq").cast("string"))
    own = events.filter(F.lower(holds).contains(text.lower())) if text else events
    key = page_key(events, sort)
    if after is not None:
        value, seq = after
        at = F.lit(value).cast(events.schema[sort].dataType)
        at = F.coalesce(at, F.lit(0.0)) if sort == "anomaly_score" else at
        tied = key.isNull() & F.lit(value is None) if value is None and sort != "anomaly_score" else key == at
        beyond = F.lit(False) if value is None and sort != "anomaly_score" else (key < at if descending else key > at) | key.isNull()
        own = own.filter(beyond | (tied & (F.col("seq") > seq)))
    ordered = own.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "seq")
    return ordered.limit(size) if after is not None else ordered.offset(page * size).limit(size)


def page_key(events: DataFrame, sort: str) -> Column:
    """What pages are sorted by: no score counts as 0, and texts go by the rules of Unicode collation."""
    if sort == "anomaly_score":
        return F.coalesce(F.col(sort), F.lit(0.0))
    return F.collate(F.col(sort), "UNICODE") if events.schema[sort].dataType.typeName() == "string" else F.col(sort)


def counts_by(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def tactic_split(events: DataFrame) -> DataFrame:
    from logloom.operators.attack import tactic_counts

    return tactic_counts(events).withColumn("side", F.when(F.col("tactic").isin(T.ATTACKER_TACTICS), "attacker").otherwise("victim"))


def report_table(events: DataFrame, n: int = 30) -> DataFrame:
    top = top_by_score(events.filter("is_anomaly"), n)
    return top.select("seq", "event_type", F.left("description", F.lit(80)).alias("description"), risk_level(F.col("anomaly_score")).alias("risk"))


def report_remainder(events: DataFrame, n: int = 30) -> DataFrame:
    """How many anomalies the report's table leaves out."""
    return events.filter("is_anomaly").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more"))


#: Types whose anomalies the infrastructure view lists, whatever their tactics.
INFRA_VIEW_TYPES = ["c2_beacon", "c2_tool", "vpn_connection", "vpn_disconnect", "vpn_ip_assigned", "dns_query", "network_connect", "suspicious_tool_installed", "package_install", "reverse_shell_attempt"]


def infra_anomalies(anomalies: DataFrame, n: int = 50) -> DataFrame:
    """The first anomalies that by type or tactic tell of an attacker's infrastructure."""
    from logloom.operators.attack import enriched

    return enriched(anomalies).filter(F.col("event_type").isin(INFRA_VIEW_TYPES) | F.col("is_attacker_infra")).orderBy("seq").limit(n)


def compact_line(events: DataFrame, long: bool = False) -> Column:
    """An anomaly in one line: time, type, score, host and address, description; ``long``: with id, user and up to three techniques."""
    from logloom.operators.attack import techniques_of
    from logloom.operators.normalize import field

    tagged = lambda label, c: F.when(field(events, c) != "", F.concat(F.lit(f"{label}="), field(events, c)))
    said = F.coalesce(F.nullif(F.coalesce(F.col("description"), F.lit("")), F.lit("")), field(events, "message"), F.lit(""))
    time = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("?"))
    head = F.format_string("[%s] %s (score=%.2f)", time, F.coalesce("event_type", F.lit("?")), F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0)))
    if not long:
        return F.concat_ws(" | ", head, tagged("host", "hostname"), tagged("ip", "src_ip"), F.left(said, F.lit(150)))
    ids = F.transform(F.slice(techniques_of(F.col("event_type")), 1, 3), lambda t: t["id"])
    head = F.concat(F.lit("["), F.coalesce(F.col("seq").cast("string"), F.lit("?")), F.lit("] "), head)
    return F.concat_ws(" | ", head, tagged("host", "hostname"), tagged("ip", "src_ip"), tagged("user", "user"), F.left(said, F.lit(200)), F.when(F.size(ids) > 0, F.concat(F.lit("MITRE: "), F.array_join(ids, ", "))))


def technique_list(anomalies: DataFrame, source: str) -> DataFrame:
    """(source_idx, technique_id, technique_name, tactic, ts, event_type, seq) of all techniques of all sources, repeats and all;
    sources count from 0 in their order. Sources are jobs, so their list is short."""
    from logloom.operators.attack import techniques_of

    names = anomalies.select(F.col(source).alias("__source")).distinct()
    index = names.withColumn("source_idx", F.row_number().over(Window.orderBy("__source")) - 1)
    own = anomalies.join(F.broadcast(index), F.col(source).eqNullSafe(F.col("__source")))
    each = own.select("source_idx", F.explode(techniques_of(F.col("event_type"))).alias("t"), "ts", "event_type", "seq")
    return each.select("source_idx", F.col("t.id").alias("technique_id"), F.col("t.name").alias("technique_name"), F.col("t.tactic").alias("tactic"), "ts", "event_type", "seq")


def indicator_list(indicators: DataFrame, n: int = 20) -> DataFrame:
    nr = F.row_number().over(Window.partitionBy("category").orderBy("value"))
    return indicators.withColumn("nr", nr).filter(F.col("nr") <= n).select("category", F.left("value", F.lit(80)).alias("value"), "nr")


def top_per_source(events: DataFrame, source: str, n: int = 5) -> DataFrame:
    order = Window.partitionBy(source).orderBy(F.desc("anomaly_score"), "seq")
    return events.withColumn("nr", F.row_number().over(order)).filter(F.col("nr") <= n)


def file_size(n: Column) -> Column:
    """In the largest unit of which there is one, with a decimal (halves are rounded up); none counts as nothing."""
    units = [(1 << 40, "TB"), (1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"), (1, "B")]
    one = lambda size, unit: F.concat(F.round(n / F.lit(float(size)), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))
    return first_of([(n >= size, one(size, unit)) for size, unit in units], "0 B")


def percent(score: Column) -> Column:
    """A whole percentage; a dash where there is no score."""
    return F.when(score.isNull(), "—").otherwise(F.format_string("%d%%", F.round(score * 100).cast("int")))


def truncated(text: Column, n: int = 80) -> Column:
    """The first ``n`` characters and an ellipsis; nothing for no text."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def duration(ms: Column) -> Column:
    """Milliseconds below a second, seconds with a decimal below a minute, then minutes and seconds."""
    tenths = F.round(ms / F.lit(1000.0), 1).cast("decimal(20,1)").cast("string")
    minutes, rest = F.floor(ms / 60000).cast("string"), F.floor(ms % 60000 / 1000).cast("string")
    return first_of([(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))), (ms < 60000, F.concat(tenths, F.lit("s")))], F.concat(minutes, F.lit("m "), rest, F.lit("s")))


def german_date(ts: Column) -> Column:
    """Day, month and year; a dash where there is no time."""
    return F.coalesce(F.date_format(ts, "dd.MM.yyyy"), F.lit("—"))
