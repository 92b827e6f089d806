"""Shared pieces: materialised tables, bounded Bloom filters and skew-proof joins."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Bloom filter that is broadcast: 2**27 bits are 2**21 words of 64 bits.
MAX_FILTER_BITS = 1 << 27


#: Spark removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run on this machine.

    Elsewhere each executor would write to its own disk, so there a missing setting is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries in here go with their end, as nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and no executor's loss loses it."""
    return materialize_parts([df], tag)


def materialize_parts(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """One table of ``parts`` (at least one, of one schema), written one after another: the shuffle files of a part are gone
    before the next one has any."""
    path = ""
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/logloom-{tag}-{uuid.uuid4().hex}"
        with cleaned(df.sparkSession):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote for these tables, once all that is made from them is itself written."""
    for table in tables:
        if table is not None and (path := _folders.pop(table, None)):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def filter_bits(n: int, per_row: int = 16, max_bits: int = MAX_FILTER_BITS) -> int:
    """A power of two of about ``per_row`` bits a row, within the bound of what is broadcast."""
    return min(max_bits, 1 << max(16, (max(n, 1) * per_row - 1).bit_length()))


def _slots(value: Column, bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), value).bitwiseAND(F.lit(bits - 1)) for seed in (1, 2)]


def bloom_words(values: DataFrame, column: str, bits: int, least: int = 1) -> DataFrame:
    """A Bloom filter with two hash functions, as rows (word, mask) of 64 bits: at most bits / 64 rows.

    ``least`` = 2 keeps only slots that at least two rows set, so that a value whose slots both pass is possibly
    repeated and any other value is surely single.
    """
    slots = values.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("slot"))
    if least > 1:
        slots = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return slots.select(F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def bloom_probe(df: DataFrame, words: DataFrame, value: Column, bits: int, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: whether ``value`` may be in the filter. The filter is bounded, so it is broadcast."""
    out, hits = df, F.lit(True)
    for i, slot in enumerate(_slots(value, bits)):
        w, m, s = f"__w{i}", f"__m{i}", f"__s{i}"
        side = F.broadcast(words.select(F.col("word").alias(w), F.col("mask").alias(m)))
        out = out.withColumn(s, slot).join(side, F.expr(f"shiftright({s}, 6)") == F.col(w), "left")
        hits = hits & F.coalesce(F.expr(f"(shiftright({m}, cast({s} & 63 as int)) & 1) = 1"), F.lit(False))
    return out.withColumn(flag, hits).drop(*(f"__{x}{i}" for x in "wms" for i in (0, 1)))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` with one row of ``groups`` a key, where a group may hold any share of the rows.

    Groups of more than total / 4096 rows (64 at least) number 4096 at most, so they are broadcast; rows of such groups take
    a key of their own (``spread``) in the shuffle join that serves all the others.
    """
    limit = max(64, total // 4096)
    values = [c for c in groups.columns if c != key]
    side = lambda df, p: df.select(F.col(key).alias(f"{p}key"), *(F.col(c).alias(f"{p}{c}") for c in values))
    hot, cold = side(groups.filter(F.col(size) > limit), "__h_"), side(groups.filter(F.col(size) <= limit), "__c_")
    kind = dict(groups.dtypes)[key]
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__h_key"), "left")
    own = F.when(F.col("__h_key").isNotNull(), spread.cast(kind)).otherwise(F.col(key))
    out = out.withColumn("__own", own).join(cold, F.col("__own") == F.col("__c_key"), "left")
    cold_value = lambda c: F.when(F.col("__h_key").isNull(), F.col(f"__c_{c}"))
    return out.select(*(F.col(c) for c in rows.columns), *(F.coalesce(F.col(f"__h_{c}"), cold_value(c)).alias(c) for c in values))


def keep_or_drop(df: DataFrame, ids: DataFrame, id_col: str, n_ids: int, keep: bool) -> DataFrame:
    """Rows of ``df`` whose id is (``keep``) or isn't in ``ids`` (one column, of the same name), whole rows of all columns.

    Only rows that a broadcast Bloom filter of the ids lets through are shuffled for the exact join; the rest stay where
    they are. Rows with a null id are never in ``ids``.
    """
    bits = filter_bits(n_ids)
    ids = ids.select(F.col(id_col)).filter(F.col(id_col).isNotNull()).distinct()
    probed = bloom_probe(df, bloom_words(ids, id_col, bits), F.col(id_col), bits, "__maybe")
    checked = probed.filter("__maybe").drop("__maybe").join(ids, id_col, "left_semi" if keep else "left_anti").select(*df.columns)
    return checked if keep else probed.filter("not __maybe").select(*df.columns).unionByName(checked)
