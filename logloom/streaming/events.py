"""The same queries over streams: events that arrive late within a watermark count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def hourly_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events an hour by type, each once by (ts, description)."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ts", "description"])
    return once.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
