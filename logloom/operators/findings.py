"""Checks for tampering. Each gives one row (category, severity, n_hits, technique, evidence) or none.

Evidence is the first few hits in timeline order, kept by a bounded top-k rather than by collecting all hits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import tables as T
from logloom.functions.classify import first_of


def _finding(hits: DataFrame, category: str, severity: Column | str, technique: str, least: int = 1, k: int = 10) -> DataFrame:
    """From hits (seq, text): counted by a partial aggregate, evidence by a top-k."""
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    counted = hits.agg(F.count(F.lit(1)).alias("n_hits")).filter(F.col("n_hits") >= least)
    first = hits.orderBy("seq", "text").limit(k).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("e"))
    return counted.join(F.broadcast(first)).select(F.lit(category).alias("category"), severity.alias("severity"), "n_hits", F.lit(technique).alias("technique"), F.transform("e", lambda x: x["text"]).alias("evidence"))


def _matching(events: DataFrame, text: Column, patterns: list[str]) -> DataFrame:
    """(seq, text) of events whose text matches a pattern: what the first one that matches found."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))
    return events.select("seq", found.alias("text")).filter("text is not null")


def timestomping(files: DataFrame) -> DataFrame:
    """Files whose metadata changed over a day after their content claims to (epoch seconds mtime, ctime)."""
    late = files.filter(F.col("ctime") - F.nullif(F.col("mtime"), F.lit(0)) > 86400)
    hits = late.select("seq", F.concat(F.col("path"), F.lit(": "), F.format_string("%.1f", (F.col("ctime") - F.col("mtime")) / 3600.0), F.lit(" h")).alias("text"))
    return _finding(hits, "timestomping", F.when(F.col("n_hits") >= 5, "high").otherwise("medium"), "T1070.006")


def log_gaps(events: DataFrame, hours: int = 6, by: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """(gap_start, gap_end, seconds) of pauses of so many hours or more, of each value of ``by``; none where there are fewer than
    ``least`` times.

    A pause that long spans the border of an hour, so only each hour's first and last time are compared: as many rows as hours.
    """
    times = events.filter("ts is not null").groupBy(*by, F.date_trunc("HOUR", "ts").alias("hour")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*by)
    before, n = F.lag("hi").over(own.orderBy("hour")), F.sum("n").over(own)
    gaps = times.select(*by, before.alias("gap_start"), F.col("lo").alias("gap_end"), n.alias("n")).filter(F.col("n") >= least).drop("n")
    return gaps.withColumn("seconds", F.unix_micros("gap_end") / 1e6 - F.unix_micros("gap_start") / 1e6).filter(F.col("seconds") >= hours * 3600)


def identical_seconds(events: DataFrame, least: int = 20) -> DataFrame:
    """Seconds that hold so many events or more."""
    return events.filter("ts is not null").groupBy(F.date_trunc("SECOND", "ts").alias("second")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def wipe_tools(events: DataFrame) -> DataFrame:
    text = F.col("description")
    tools = _matching(events, text, [rf"(?i)\b{t}\b" for t in T.WIPE_TOOLS])
    return _finding(tools.unionByName(_matching(events, text, [T.DD_WIPE])), "wipe_tools", "high", "T1485")


def log_clearing(events: DataFrame) -> DataFrame:
    return _finding(_matching(events, F.col("description"), T.LOG_CLEARING), "log_clearing", "high", "T1070.002")


def time_tools(events: DataFrame) -> DataFrame:
    """Tools that set the clock; 'date' alone needs three hits."""
    hits = _matching(events, F.col("description"), [rf"(?i)\b{t}\b" for t in T.TIME_TOOLS])
    enough = hits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("text") != "date").alias("other")).filter((F.col("other") > 0) | (F.col("n") >= 3))
    return _finding(hits, "time_manipulation", "medium", "T1070.006").join(F.broadcast(enough.select(F.lit(1).alias("__1")))).drop("__1")


def rootkits(events: DataFrame) -> DataFrame:
    return _finding(_matching(events, F.concat_ws(" ", "description", "path"), T.ROOTKIT), "rootkit", "high", "T1014")


def truncated_logs(files: DataFrame) -> DataFrame:
    hits = files.filter(F.col("path").rlike(r"^/var/log/.+$") & (F.col("size") == 0)).select("seq", F.col("path").alias("text"))
    return _finding(hits, "truncated_logs", "medium", "T1070.002", k=15)


def deletions(events: DataFrame) -> DataFrame:
    return _finding(_matching(events, F.col("description"), [T.DELETIONS]), "suspicious_deletions", "high", "T1070.004")


def gap_finding(events: DataFrame) -> DataFrame:
    hits = log_gaps(events).select(F.col("gap_start").cast("long").alias("seq"), F.format_string("%.1f h", F.col("seconds") / 3600.0).alias("text"))
    return _finding(hits, "log_gap", F.when(F.col("n_hits") > 1, "high").otherwise("medium"), "T1070", k=5)


def second_finding(events: DataFrame) -> DataFrame:
    hits = identical_seconds(events).select((-F.col("n")).alias("seq"), F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return _finding(hits, "identical_timestamps", "medium", "T1070.006", k=5)


#: The checks that a row passes by itself: severity, technique, pieces of evidence.
ROW_CHECKS = {
    "timestomping": ("", "T1070.006", 10), "wipe_tools": ("high", "T1485", 10), "log_clearing": ("high", "T1070.002", 10), "time_manipulation": ("medium", "T1070.006", 10),
    "rootkit": ("high", "T1014", 10), "truncated_logs": ("medium", "T1070.002", 15), "suspicious_deletions": ("high", "T1070.004", 10),
}
#: What any check of a text finds, or more.
ANY_CHECK = "|".join(f"(?:{p})" for p in (rf"(?i)\b(?:{'|'.join(T.WIPE_TOOLS + T.TIME_TOOLS)})\b", T.DD_WIPE, *T.LOG_CLEARING, *T.ROOTKIT, T.DELETIONS))
#: Evidence of a check that is kept on the way: as much as any check shows.
KEPT = 15


def _hits(events: DataFrame, files: DataFrame) -> DataFrame:
    """(category, seq, text) of all checks on rows, and (null, null, null, ts) of each event: one scan of either table."""
    hit = lambda category, text: F.struct(F.lit(category).alias("category"), F.col("seq").cast("long").alias("seq"), text.alias("text"), F.lit(None).cast("timestamp").alias("ts"))
    found = lambda category, text, patterns: (lambda t: F.when(t.isNotNull(), hit(category, t)))(F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns)))
    words = lambda tools: [rf"(?i)\b{t}\b" for t in tools]
    said, whole = F.col("description"), F.concat_ws(" ", "description", "path")
    time = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), F.col("ts").alias("ts"))
    own = (found("wipe_tools", said, words(T.WIPE_TOOLS)), found("wipe_tools", said, [T.DD_WIPE]), found("log_clearing", said, T.LOG_CLEARING), found("time_manipulation", said, words(T.TIME_TOOLS)), found("rootkit", whole, T.ROOTKIT), found("suspicious_deletions", said, [T.DELETIONS]))
    # most events pass no check, which one pattern of all tells; what is found in the description is found in the whole text
    of_event = F.when(whole.rlike(ANY_CHECK), F.array_compact(F.array(time, *own))).otherwise(F.array(time))
    late = F.col("ctime") - F.nullif(F.col("mtime"), F.lit(0))
    stomped = F.concat(F.col("path"), F.lit(": "), F.format_string("%.1f", (F.col("ctime") - F.col("mtime")) / 3600.0), F.lit(" h"))
    empty = F.col("path").rlike(r"^/var/log/.+$") & (F.col("size") == 0)
    of_file = F.array_compact(F.array(F.when(late > 86400, hit("timestomping", stomped)), F.when(empty, hit("truncated_logs", F.col("path")))))
    own = [t.select(F.explode(a).alias("h")).select("h.*") for t, a in ((events, of_event), (files, of_file))]
    return own[0].unionByName(own[1])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: count, first KEPT hits and count of other texts than 'date' of each category; count, first and last time of
    each second of a batch."""
    kept: dict[str, list[tuple[int, str]]] = {}
    count: dict[str, list[int]] = {}
    for batch in batches:
        rows = pc.is_valid(batch.column(0))
        hits, times = batch.filter(rows), batch.column(3).filter(pc.invert(rows))
        category, seq = hits.column(0), pc.fill_null(hits.column(1), -(1 << 63)).to_numpy()
        for c in pc.unique(category).to_pylist():
            here = np.flatnonzero(pc.equal(category, c).to_numpy(zero_copy_only=False))
            said, at, own = hits.column(2).take(pa.array(here)), seq[here], kept.get(c, [])
            n = count.setdefault(c, [0, 0])
            n[0] += len(here)
            n[1] += len(here) - (pc.sum(pc.equal(pc.utf8_lower(said), "date")).as_py() or 0)
            bounds = [own[-1][0]] if len(own) == KEPT else []
            if len(at) >= KEPT:
                bounds.append(np.partition(at, KEPT - 1)[KEPT - 1])
            first = np.flatnonzero(at <= min(bounds)) if bounds else np.arange(len(at))  # ties go by their texts
            kept[c] = heapq.nsmallest(KEPT, [*own, *zip(at[first].tolist(), said.take(pa.array(first)).to_pylist(), strict=True)])
        known = np.sort(times.drop_null().cast(pa.int64()).to_numpy())
        second, start, n = np.unique(known // 1_000_000, return_index=True, return_counts=True)
        yield _rows(len(second), second=second, n=n, lo=known[start], hi=known[start + n - 1] if len(n) else known)
        if blank := len(times) - len(known):
            yield _rows(1, n=[blank])
    names = sorted(kept)
    yield _rows(len(names), category=names, n=[count[c][0] for c in names], other=[count[c][1] for c in names])
    first = [(c, {"seq": s, "text": t}) for c in names for s, t in kept[c]]
    yield _rows(len(first), category=[c for c, _ in first], hit=[h for _, h in first])


_PART = {"category": pa.string(), "second": pa.int64(), "hit": pa.struct([("seq", pa.int64()), ("text", pa.string())]), "n": pa.int64(), "other": pa.int64(), "lo": pa.int64(), "hi": pa.int64()}


def _rows(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in _PART.items()], list(_PART))


def all_findings(events: DataFrame, files: DataFrame, least: int = 20) -> DataFrame:
    """All checks in one pass: each table is read once. Those on times count only where there are ``least`` events.

    Partitions count their hits and keep the first of each check; seconds are added up by numbers alone, then hours, whose first and
    last times tell the gaps; hours are few, so one task may see them all.
    """
    parts = _hits(events, files).mapInArrow(_partial, "category string, second long, hit struct<seq:long,text:string>, n long, other long, lo long, hi long")
    added = [F.sum("n").alias("n"), F.sum("other").alias("other"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    seconds = parts.groupBy("category", "second", "hit").agg(*added, F.count("hit").alias("times"))
    busy = F.when(F.col("second").isNotNull() & (F.col("n") >= 20), F.struct((-F.col("n")).alias("seq"), F.date_format(F.timestamp_seconds("second"), "yyyy-MM-dd HH:mm:ss").alias("text")))
    own = seconds.withColumn("busy", busy).withColumn("first", F.when(F.col("hit").isNotNull(), F.array_repeat("hit", F.col("times").cast("int"))).when(F.col("busy").isNotNull(), F.array("busy")))
    merged = lambda n: F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, n)  # noqa: E731  of an hour 3600 at most, of a check KEPT a partition
    hours = own.groupBy("category", F.expr("second div 3600").alias("hour")).agg(*added, F.count("busy").alias("n_busy"), merged(KEPT).alias("first"))
    before = F.lag("hi").over(Window.partitionBy("category").orderBy(F.col("hour").asc_nulls_first()))
    pause = (F.col("lo") - before) / 1e6
    gaps = hours.withColumn("gap", F.when(pause >= 6 * 3600, F.struct(F.floor(before / 1_000_000).alias("seq"), F.format_string("%.1f h", pause / 3600.0).alias("text"))))
    total = gaps.groupBy("category").agg(F.sum("n").alias("n"), F.sum("other").alias("other"), F.sum("n_busy").alias("n_busy"), F.count("gap").alias("n_gaps"), F.sum(F.when(F.col("hour").isNotNull(), F.col("n"))).alias("n_timed"), merged(KEPT).alias("first"), F.slice(F.array_sort(F.collect_list("gap")), 1, 5).alias("gaps"))
    # as many rows as checks: the row without a category holds the times
    enough = F.coalesce(F.col("n_events") >= least, F.lit(False))
    finding = lambda category, severity, n, technique, first: F.struct(F.lit(category).alias("category"), severity.alias("severity"), n.alias("n_hits"), F.lit(technique).alias("technique"), F.transform(first, lambda x: x["text"]).alias("evidence"))
    timed = F.array(
        F.when(enough & (F.col("n_gaps") > 0) & (F.col("n_timed") >= 10), finding("log_gap", F.when(F.col("n_gaps") > 1, "high").otherwise("medium"), F.col("n_gaps"), "T1070", F.col("gaps"))),
        F.when(enough & (F.col("n_busy") > 0), finding("identical_timestamps", F.lit("medium"), F.col("n_busy"), "T1070.006", F.slice("first", 1, 5))),
    )
    by_row = []
    for category, (severity, technique, k) in ROW_CHECKS.items():
        level = F.lit(severity) if severity else F.when(F.col("n") >= 5, "high").otherwise("medium")
        holds = F.col("category") == category
        if category == "timestomping":
            holds &= enough
        if category == "time_manipulation":  # 'date' alone needs three hits
            holds &= (F.col("other") > 0) | (F.col("n") >= 3)
        by_row.append(F.when(holds, finding(category, level, F.col("n"), technique, F.slice("first", 1, k))))
    found = total.withColumn("n_events", F.max(F.when(F.col("category").isNull(), F.col("n"))).over(Window.partitionBy()))
    return found.select(F.explode(F.array_compact(F.when(F.col("category").isNull(), timed).otherwise(F.array(*by_row)))).alias("f")).select("f.*")


def risk(findings: DataFrame) -> DataFrame:
    """Score 0 to 100, level, number of findings, their categories, and a sentence that sums them up."""
    weight = F.when(F.col("severity") == "high", 20).when(F.col("severity") == "medium", 10).otherwise(5)
    out = findings.agg(F.least(F.lit(100), F.coalesce(F.sum(weight), F.lit(0))).cast("long").alias("risk_score"), F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_set("category")).alias("categories"))
    out = out.withColumn("risk_level", risk_level(F.col("risk_score")))
    return out.withColumn("summary", F.when(F.col("n_findings") == 0, "no signs of tampering").otherwise(F.format_string("%d findings, risk %d of 100 (%s): %s", "n_findings", "risk_score", "risk_level", F.array_join("categories", ", "))))


def risk_level(score: Column) -> Column:
    return first_of([(score >= 60, "critical"), (score >= 40, "high"), (score >= 20, "medium"), (score > 0, "low")], "none")
