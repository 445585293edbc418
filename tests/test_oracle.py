"""Every registered query against its DuckDB statement on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    result = compare(spark, con, name, entry.queries()[name], CHECKS.get(name), SF)
    assert result["rows"] > 0
    assert result["ok"] is (True if name in CHECKS else None), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
