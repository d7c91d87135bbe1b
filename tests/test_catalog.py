import pytest

from sandhi.plans import catalog
from tests.oracle import compare, tables

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return tables(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    compare(df, SQL[name], con)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
