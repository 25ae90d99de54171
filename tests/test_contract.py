"""Every registered query runs on the smallest folder and equals its SQL."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from tests.conftest import DATA

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), DATA)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["row_id", "label", "feature_idx", "value"]
    assert df.count() == 500 * 16
