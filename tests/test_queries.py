import pytest
from latticeframe.plans import roundtrips, systems  # noqa: F401 - they add their queries
from latticeframe.plans.queries import ORACLES, QUERIES

from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    assert difference(spark, db, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
