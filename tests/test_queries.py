import pytest

from pagemill import queries
from tests.compare import check

QUERIES, SQL = queries.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    check(spark, QUERIES[name], SQL[name])
