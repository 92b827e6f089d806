"""Indicators of compromise: extraction, intelligence lookups, correlation between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import tables as T
from logloom.functions.classify import first_of
from logloom.operators.normalize import field
from logloom.operators.patterns import matches

CATEGORIES = {"ips": "ip", "domains": "domain", "users": "user", "processes": "process", "files": "file", "hostnames": "hostname"}


def _array(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def indicator_values(text: Column, user: Column, process: Column, hostname: Column, path: Column, src_ip: Column) -> Column:
    """Array of (category, value) of one event."""
    given = lambda c, *no: F.when(c.isNotNull() & ~c.isin("", *no), c)
    find = lambda p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    ips = F.filter(F.concat(find(T.IPV4, 0), _array(given(src_ip))), lambda x: ~x.isin("127.0.0.1", "0.0.0.0"))
    named = F.filter(F.concat(find(r"(?i)user[=: ]+(\w+)", 1), find(r"(?i)for (\w+) from", 1)), lambda x: F.length(x) > 1)
    by = {"ips": ips, "domains": find(T.DOMAIN, 0), "users": F.concat(_array(given(user, "-", "None")), named), "processes": _array(given(process, "None")), "files": _array(given(path, "/")), "hostnames": _array(given(hostname, "None"))}
    named_by = lambda k: lambda x: F.struct(F.lit(k).alias("category"), x.alias("value"))  # noqa: E731  one parameter: a second would be the index
    return F.concat(*(F.transform(v, named_by(k)) for k, v in by.items()))


def extracted(events: DataFrame, *keys: str) -> DataFrame:
    """Different (category, value) of events, for each value of ``keys``, from their columns and their metadata."""
    own = indicator_values(F.coalesce(F.col("description"), F.lit("")), *(field(events, c) for c in ("user", "process", "hostname", "path", "src_ip")))
    return events.select(*keys, F.explode(F.array_distinct(own)).alias("i")).select(*keys, "i.*").distinct()


#: Days for which a reputation holds, and keys over which the events of one value are spread.
REPUTATION_DAYS, SPREAD = 90, 8


def looked_up(indicators: DataFrame, kb: DataFrame, reputations: DataFrame | None = None) -> DataFrame:
    """Indicators with what a knowledge base says of them; its first entry of a value counts (column ``nr``). With ``reputations``
    (value, score from 0 to 100, at), addresses also have the score that held at their ``ts``."""
    first = kb.groupBy(F.lower(F.trim("value")).alias("__value")).agg(F.min_by(F.struct("threat", F.coalesce("confidence", F.lit("medium")).alias("confidence")), "nr").alias("kb"))
    own = indicators if reputations is None else with_reputation(indicators, reputations)
    score = F.lit(None).cast("int") if reputations is None else F.when(F.col("category") == "ips", F.col("__score"))
    out = own.withColumn("__abuse", score).join(first, F.lower(F.trim("value")) == F.col("__value"), "left")
    known, abuse = F.col("kb.confidence"), F.col("__abuse")
    levels = F.array(known, first_of([(abuse >= 75, "high"), (abuse >= 25, "medium"), (abuse.isNotNull(), "low")], F.lit(None).cast("string")))
    confidence = first_of([(F.array_contains(F.array_compact(levels), c), c) for c in ("high", "medium")] + [(known.isNotNull() | abuse.isNotNull(), "low")], "unknown")
    return out.select(*indicators.columns, F.col("kb.threat").alias("threat"), confidence.alias("confidence"), *([abuse.alias("abuse_score")] if reputations is not None else []), verdict(known, abuse).alias("verdict"))


def with_reputation(indicators: DataFrame, reputations: DataFrame) -> DataFrame:
    """Indicators (value, ts, ...) with ``__score``: the latest score of their value at their time or up to 90 days before it.

    An as-of join by one sort: both go by value and spans of 90 days, an entry to its span and the next one, for one more is too
    late. Values with many events are spread over several keys, to each of which the few entries of the value go.
    """
    span = lambda c: F.floor(F.unix_seconds(c) / (REPUTATION_DAYS * 86400))
    rows = indicators.select(F.lower(F.trim("value")).alias("__v"), span("ts").alias("__span"), F.pmod(F.xxhash64(*(c for c in indicators.columns)), F.lit(SPREAD)).alias("__key"), F.col("ts").alias("__at"), F.lit(1).alias("__kind"), F.struct(*indicators.columns).alias("__row"), F.lit(None).cast("struct<at:timestamp,score:int>").alias("__entry"))
    entries = reputations.filter("value is not null and at is not null and score is not null").select(F.lower(F.trim("value")).alias("__v"), F.explode(F.array(span("at"), span("at") + 1)).alias("__span"), F.col("at").alias("__at"), F.struct(F.col("at").cast("timestamp").alias("at"), F.col("score").cast("int").alias("score")).alias("__entry"))
    entries = entries.withColumn("__key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))).withColumn("__kind", F.lit(0))
    both = rows.unionByName(entries, allowMissingColumns=True)
    order = Window.partitionBy("__v", "__span", "__key").orderBy("__at", "__kind", F.col("__entry.score"))
    latest = F.last("__entry", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("__latest", latest).filter("__kind = 1")
    holds = F.col("__at") <= F.col("__latest.at") + F.make_dt_interval(F.lit(REPUTATION_DAYS))
    return met.select("__row.*", F.when(holds, F.col("__latest.score")).alias("__score"))


def verdict(kb_confidence: Column, abuse_score: Column) -> Column:
    """By the knowledge base where it knows the value, else by a reputation score from 0 to 100."""
    return first_of([(kb_confidence == "high", "malicious"), (kb_confidence.isNotNull(), "suspicious"), (abuse_score >= 50, "malicious"), (abuse_score >= 25, "suspicious"), (abuse_score.isNotNull(), "clean")], "unknown")


def context_matches(events: DataFrame, kb: DataFrame) -> DataFrame:
    """(seq, value) where an event's text holds a value of the knowledge base anywhere, whatever the case: any number of values."""
    return matches(events, kb, "seq", "description", "value")


def signature_matches(events: DataFrame, signatures: list[tuple[str, str, str]]) -> DataFrame:
    """(seq, name, severity) of each signature (name, pattern, severity) that an event's text matches. The list is fixed code."""
    found = F.array_compact(F.array(*(F.when(F.col("description").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, p, s in signatures)))
    return events.select("seq", F.explode(found).alias("s")).select("seq", "s.*")


def shared(indicators: DataFrame, source: str, least: int = 2) -> DataFrame:
    """Values in so many sources or more, with how many and which, in order. Sources are jobs: a list holds each once."""
    by = indicators.groupBy("category", "value").agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return by.select("category", "value", F.size("sources").cast("long").alias("n_sources"), "sources").filter(F.col("n_sources") >= least)


def near_in_time(events: DataFrame, value: str, source: str, seconds: int) -> DataFrame:
    """Pairs of events of different sources with the same value, at most so many seconds apart: an equi-join on time buckets."""
    rows = events.filter(F.col("ts").isNotNull() & F.col(value).isNotNull()).select("seq", F.col("ts"), F.col(source).alias("source"), F.col(value).alias("value"), F.floor(F.unix_seconds("ts") / seconds).alias("bucket"))
    left = rows.select(F.col("seq").alias("seq_a"), F.col("ts").alias("ts_a"), F.col("source").alias("source_a"), "value", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(F.col("seq").alias("seq_b"), F.col("ts").alias("ts_b"), F.col("source").alias("source_b"), "value", "bucket")
    met = left.join(right, ["value", "bucket"]).filter((F.col("source_a") < F.col("source_b")) & (F.abs(F.unix_micros("ts_a") - F.unix_micros("ts_b")) <= seconds * 1_000_000))
    return met.select("seq_a", "seq_b", "value")


def prompt_lines(events: DataFrame, budget: int = 10_000) -> DataFrame:
    """The first lines whose total length stays within a budget: at most ``budget`` rows can, so only those are ranked."""
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", "description")
    first = events.select("seq", line.alias("line")).orderBy("seq").limit(budget)
    used = F.sum(F.length("line") + 1).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).filter(F.col("used") <= budget)


def case_jobs(cases: DataFrame, jobs: DataFrame) -> DataFrame:
    """(case_id, job_id) of known jobs."""
    bridge = cases.select("case_id", F.explode("job_ids").alias("job_id")).distinct()
    return bridge.join(jobs.select("job_id").distinct(), "job_id").select("case_id", "job_id")


def unassigned(cases: DataFrame, jobs: DataFrame) -> DataFrame:
    return jobs.join(cases.select(F.explode("job_ids").alias("job_id")).distinct(), "job_id", "left_anti")


def find_cases(cases: DataFrame, jobs: DataFrame, text: str) -> DataFrame:
    """Cases whose name or number holds a text, or one of whose jobs' file names does."""
    holds = lambda c: F.lower(c).contains(text.lower())
    hits = jobs.filter(holds("filename")).select("job_id")
    by_job = cases.select("case_id", F.explode("job_ids").alias("job_id")).join(hits, "job_id", "left_semi").select("case_id").distinct().withColumn("__hit", F.lit(True))
    return cases.join(by_job, "case_id", "left").filter(F.coalesce(holds("name"), F.lit(False)) | F.coalesce(holds("case_number"), F.lit(False)) | F.col("__hit")).drop("__hit")


def with_job(cases: DataFrame, case_id: str | int, job_id: str | int, remove: bool = False) -> DataFrame:
    """Cases with a job added to one (once) or taken from it."""
    job = F.lit(job_id).cast(cases.schema["job_ids"].dataType.elementType)
    own = F.array_remove("job_ids", job) if remove else F.array_union("job_ids", F.array(job))
    return cases.withColumn("job_ids", F.when(F.col("case_id") == case_id, own).otherwise(F.col("job_ids")))
