"""Results of jobs and cases, kept so that a change that fails halfway changes nothing.

Results of a kind are one table, partitioned by job: writing replaces the partition of its job alone, once all is written, and
reading several jobs is one scan of their partitions. Cases are a small table that is written whole as a new version; the version
that counts is the latest one that was written to its end.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.indicators import with_job

CASE = "case_id string, name string, case_number string, description string, analyst string, job_ids array<string>, created_at timestamp, updated_at timestamp"
#: Versions that stay besides the one that counts, for readers that began with them.
KEPT = 2


def plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for formats without them."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")}
    return df.select(*(F.to_json(f"`{c}`").alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns))


def write_result(df: DataFrame, root: str, kind: str, job_id: str, form: str = "parquet") -> None:
    """Replaces what ``root``/``kind`` holds of a job, as parquet, json or csv (with a header); other jobs' rows stay untouched."""
    own = (plain(df) if form == "csv" else df).withColumn("job_id", F.lit(job_id))
    own.write.partitionBy("job_id").option("partitionOverwriteMode", "dynamic").option("header", True).mode("overwrite").format(form).save(f"{root}/{kind}")


def read_results(spark: SparkSession, root: str, kind: str, schema: str, jobs: list[str] | None = None, form: str = "parquet") -> DataFrame:
    """Rows of a kind with their job_id, of all jobs or of some: one scan, of the partitions of those jobs only. No rows where
    nothing was written yet, and none of jobs that have none."""
    if not _exists(spark, f"{root}/{kind}"):
        return spark.createDataFrame([], f"{schema}, job_id string")
    own = spark.read.schema(f"{schema}, job_id string").option("header", True).format(form).load(f"{root}/{kind}")
    return own if jobs is None else own.filter(F.col("job_id").isin(jobs))


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


class Cases:
    """A store of cases below a folder, one writer at a time: of two that write the same version the later one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Those written to their end, in order."""
        at, system = _path(self.spark, self.path)
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)) and _exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def table(self) -> DataFrame:
        own = self.versions()
        return self.spark.read.schema(CASE).parquet(f"{self.path}/v{own[-1]}") if own else self.spark.createDataFrame([], CASE)

    def listed(self) -> DataFrame:
        """All cases, the last changed first."""
        return self.table().orderBy(F.desc("updated_at"), "case_id")

    def get(self, case_id: str) -> DataFrame:
        return self.table().filter(F.col("case_id") == case_id)

    def _write(self, cases: DataFrame) -> None:
        at, system = _path(self.spark, self.path)
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        own = self.versions()
        latest = max([0, *(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))])  # also one that was left half-written
        cases.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v{latest + 1}")
        for old in own[: -KEPT if KEPT else None]:
            gone, system = _path(self.spark, f"{self.path}/v{old}")
            system.delete(gone, True)

    def _changed(self, case_id: str, change) -> None:
        """Writes the table with ``change`` made to one case; a case that isn't there is an error."""
        own = self.table()
        if own.filter(F.col("case_id") == case_id).isEmpty():
            raise KeyError(case_id)
        here = F.col("case_id") == case_id
        self._write(change(own).withColumn("updated_at", F.when(here, F.current_timestamp()).otherwise(F.col("updated_at"))))

    def create(self, name: str, case_number: str = "", description: str = "", analyst: str = "", job_ids: list[str] | None = None) -> str:
        """A new case; returns its id of 12 characters."""
        case_id = str(uuid.uuid4())[:12]
        now = F.current_timestamp()
        own = self.spark.createDataFrame([(case_id, name, case_number, description, analyst, job_ids or [])], CASE.split(", created_at")[0])
        self._write(self.table().unionByName(own.withColumn("created_at", now).withColumn("updated_at", now)))
        return case_id

    def update(self, case_id: str, **fields) -> None:
        """Sets the given fields (name, case_number, description, analyst, job_ids) of a case; None leaves a field as it is."""
        if unknown := set(fields) - {"name", "case_number", "description", "analyst", "job_ids"}:
            raise ValueError(f"a case has no {', '.join(sorted(unknown))}")
        new = {c: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for c, v in fields.items() if v is not None}
        self._changed(case_id, lambda own: own.withColumns({c: F.when(F.col("case_id") == case_id, v).otherwise(F.col(c)) for c, v in new.items()}))

    def delete(self, case_id: str) -> None:
        """Takes a case away; the results of its jobs stay."""
        if self.get(case_id).isEmpty():
            raise KeyError(case_id)
        self._write(self.table().filter(F.col("case_id") != case_id))

    def add_job(self, case_id: str, job_id: str) -> None:
        self._changed(case_id, lambda own: with_job(own, case_id, job_id))

    def remove_job(self, case_id: str, job_id: str) -> None:
        self._changed(case_id, lambda own: with_job(own, case_id, job_id, remove=True))
