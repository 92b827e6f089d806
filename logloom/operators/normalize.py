"""Parsed events in one schema, without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_time(number: Column, text: Column) -> Column:
    """A time from epoch seconds or from text, else null."""
    return F.coalesce(F.timestamp_seconds(number), text.try_cast("timestamp"))


def inferred_type(given: Column, event_id: Column, inode: Column, provider: Column) -> Column:
    known = F.nullif(F.when(given.isin("unknown", "log_entry"), F.lit("")).otherwise(F.coalesce(given, F.lit(""))), F.lit(""))
    return F.coalesce(known, F.when(event_id.isNotNull(), "windows_event").when(inode.isNotNull(), "file_system").when(provider.isNotNull(), "log_entry").otherwise("unknown"))


def description(message: Column, event_type: Column, path: Column, name: Column) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(message), F.when(given(path).isNotNull(), F.concat(event_type, F.lit(": "), path)), F.when(given(name).isNotNull(), F.concat(F.lit("File: "), name)), F.lit(""))


def stable_id(source: Column, inode: Column, *rest: Column) -> Column:
    """An id that is the same in each run: by inode, or by a hash of what identifies the line."""
    return F.concat(source, F.lit("_"), F.coalesce(inode.cast("string"), F.hex(F.xxhash64(*rest))))


def normalized(parsed: DataFrame, seq: str = "seq", metadata: bool = False) -> DataFrame:
    """Events with id, ts, event_type, source, description from parsed lines (source, event_type, message, path, raw_line).

    With ``metadata``, every field of the line but its time is also kept in a variant column of that name, so that tables of
    different sources meet in one schema; ``field`` reads it.
    """
    none = F.lit(None)
    kind = inferred_type(F.col("event_type"), none, none, none)
    out = parsed.withColumn("event_type", kind).withColumn("ts_synthetic", F.col("ts").isNull())
    out = out.withColumn("event_key", stable_id(F.col("source"), none, F.col("raw_line"), F.col(seq)))
    out = out.withColumn("description", description(F.col("message"), F.col("event_type"), F.col("path"), none))
    return with_metadata(out, *(c for c in parsed.columns if c not in ("ts", seq))) if metadata else out


def with_metadata(events: DataFrame, *fields: str) -> DataFrame:
    """``events`` with the given fields as one variant column; those that are null are left out of it."""
    return events.withColumn("metadata", F.parse_json(F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields)))))


def field(events: DataFrame, name: str, kind: str = "string") -> Column:
    """A field of events: the column of that name, and what metadata hold of it where there is no column, or nothing in it."""
    own = [F.col(f"`{name}`").cast(kind)] if name in events.columns else []
    if "metadata" in events.columns and events.schema["metadata"].dataType.typeName() == "variant":
        own.append(F.try_variant_get("metadata", f"$.{name}", kind))
    return F.coalesce(*own) if own else F.lit(None).cast(kind)


def united(*sources: DataFrame) -> DataFrame:
    """All sources in one; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("ts", "description"), seq: str = "seq") -> DataFrame:
    """Of events with equal keys the first by ``seq``, in one shuffle: rows of a key are reduced before it, so that a key may
    have any number of them. Nulls are equal to each other. ``seq`` is unique."""
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("__first"))
    return first.select(*(F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in events.columns))


def partition_summary(files: DataFrame) -> DataFrame:
    """For each partition the file system of its first record, and the number of records."""
    return files.groupBy("partition").agg(F.min_by("filesystem", "seq").alias("filesystem"), F.count(F.lit(1)).alias("n_events"))


def with_context(events: DataFrame, **context: str) -> DataFrame:
    return events.withColumns({k: F.lit(v) for k, v in context.items()})


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")
