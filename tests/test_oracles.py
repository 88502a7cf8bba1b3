"""Every registered query against DuckDB on the smallest scale, or at least a non-empty result."""

from __future__ import annotations

import pytest
from oracle_check import compare, oracle_connection

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# results that are empty on the smallest scale
MAY_BE_EMPTY = {"anomaly_scan_table"}


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        problem, _ = compare(df, duck, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "cat_revenue"]
    assert df.count() > 0
