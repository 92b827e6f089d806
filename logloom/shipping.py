"""The package for Python workers that don't have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Sends this package to all workers of a session, as ``--py-files`` does; returns the archive's path. Call it once, before the
    first query, where the driver was started from another folder than the executors' or the package isn't installed there."""
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="logloom-"))
    shutil.copytree(root, at / "in" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(at / root.name), "zip", at / "in")
    spark.sparkContext.addPyFile(archive)
    return archive
