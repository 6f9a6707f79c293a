"""Every registered query against its DuckDB statement on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.conftest import SF

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert differences(result, duck, ORACLE[name]) == []
    else:
        assert result.count() > 0


def test_statements_have_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
