"""Registered queries of the event engine against their SQL."""

import duckdb
import pytest

from logloom.plans.queries import ORACLES, QUERIES, entry
from tests.compare import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df) == sql_rows(ORACLES[name], SF, df.columns)


def test_entry_has_rows(spark):
    assert entry(spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_sums_of_contents_beyond_64_bits(spark, tmp_path):
    """Numbers of events whose sum, and whose sum times their places, no long holds."""
    for name, columns in (("events", "* replace (event_id + 10000000000000000 as event_id)"), ("lineitem", "*"), ("orders", "*")):
        duckdb.execute(f"copy (select {columns} from '{SF}/{name}.parquet') to '{tmp_path}/{name}.parquet'")
    df = QUERIES["K_written_contents"](spark, str(tmp_path))
    got = rows_of(df)
    assert got == sql_rows(ORACLES["K_written_contents"], str(tmp_path), df.columns)
    assert all(int(dict(zip(sorted(df.columns), r))["held"]) > 1 << 63 for r in got if "provenance" in r)
