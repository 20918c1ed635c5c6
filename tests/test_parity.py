import pytest

from tests.parity import connection, difference
from wattspark import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    assert difference(registry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(registry.queries())
