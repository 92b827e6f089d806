"""Intermediate tables in the folder that driver and executors share, global numbers, and exact quantiles over them."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges into which a search for a quantile divides the values, and values that are few enough to be looked at one by one.
RANGES, FEW = 1 << 12, 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where all run on this machine; elsewhere a missing setting is an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/logloom-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as written to the shared folder: computed once, and not lost with an executor."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, to: str = "nr") -> DataFrame:
    """``df`` with the numbers 1, 2, 3, ... of its rows by ``order``: ranges are sorted each by itself and written, then each
    adds the sizes of those before it. No task holds more than its range. An order with ties numbers them as they come."""
    place = stored(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("__at")), "ordered")
    part = F.expr("shiftright(__at, 33)")
    sizes = sorted((r["p"], r["n"]) for r in place.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    side = df.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    own = place.withColumn("__part", part).join(F.broadcast(side), "__part")
    return own.select(*df.columns, (F.col("__before") + F.expr("__at & 8589934591") + 1).alias(to))


def nth(values: DataFrame, column: str, *ranks: int) -> list[float | None]:
    """The values of the given ranks (from 0) of a column of doubles, nulls and NaN left out: ranges are counted, and the one that
    holds a rank is divided again, until few different values are left. Each round returns RANGES counts to the driver."""
    own = values.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    out = []
    for rank in ranks:
        held, before = own, 0
        while True:
            low, high, n = held.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
            if not n or rank - before >= n:
                out.append(None)
                break
            width = (high - low) / RANGES
            if n <= FEW or low == high or low + width == low:  # at the last, ranges can't get narrower: neighbouring doubles
                counts = sorted(tuple(r) for r in held.groupBy("v").count().collect())
                at = before
                for v, m in counts:
                    at += m
                    if rank < at:
                        out.append(v)
                        break
                break
            bucket = F.least(F.floor((F.col("v") - low) / width), F.lit(RANGES - 1))
            counts = dict(tuple(r) for r in held.groupBy(bucket.alias("b")).count().collect())
            for b in sorted(counts):
                if rank < before + counts[b]:
                    held = held.filter(bucket == b)
                    break
                before += counts[b]
    return out


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, interpolated between the two values next to it; null of no values."""
    n = values.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = int(at), min(int(at) + 1, n - 1)
    a, b = nth(values, column, low, high) if high != low else nth(values, column, low) * 2
    return a + (b - a) * (at - low)
