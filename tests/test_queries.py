"""Every query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

from kinlink.queries import ORACLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, compare  # noqa: E402


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, small, name):
    _, verdict = compare(spark, db, name, small)
    assert verdict.startswith("same"), verdict
