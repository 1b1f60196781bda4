import pytest
from latticeframe.llm.queries import oracle_sql, queries

from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, connection(SF), queries()[name], oracle_sql()[name], SF) is None


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 14)]
