"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, msg, _ = compare(spark, con, name, entry.queries()[name], ORACLES[name], SF)
    assert ok, msg


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and "gini" in rows[0].asDict()


def test_names_have_queries():
    assert set(ORACLES) <= set(entry.queries())
