"""Workers of a session that was started elsewhere can import the package once it is shipped."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
sys.path.append(sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from logloom.operators.patterns import matches
from logloom.shipping import ship
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
texts = spark.createDataFrame([(1, "a needle here")], "seq long, description string")
print("found", [r["value"] for r in matches(texts, spark.createDataFrame([("needle",), ("no",)], "value string"), "seq", "description", "value").collect()])
"""


def test_package_is_shipped(tmp_path):
    """The workers are started from a folder without the package, with nothing of it on their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROGRAM, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "found ['needle']" in out.stdout, out.stderr[-2000:]
