import pytest
from corvane import queries

from tests.compare import oracle, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ok, why = same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], con)
    assert ok, why


def test_flagship(spark):
    assert queries.flagship(spark, "/root/testdata/sf0.001").columns == ["doc_id"]
