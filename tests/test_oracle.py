import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, sf, name, queries()[name], oracle_sql()[name]).startswith("ok")


def test_entry(spark):
    assert entry(spark).count() > 0
