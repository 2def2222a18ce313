import pytest

from tests.compare import connect, difference
from tickweave.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) is None
