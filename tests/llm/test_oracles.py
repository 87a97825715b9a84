import pytest

from pagemill.llm import registry
from tests.compare import check


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name])
