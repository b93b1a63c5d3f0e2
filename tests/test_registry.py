"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
import check


@pytest.fixture(scope="module")
def connection(testdata):
    return check.oracle(testdata)


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert set(contract.QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query(spark, connection, testdata, name):
    problem, rows = check.differences(spark, connection, testdata, name)
    assert problem is None
    assert rows > 0
