import pytest

from tests.compare import assert_same
from tidecrawl.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, name, size):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name], f"/root/testdata/{size}")
