import pytest

from tessera.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    oracle.same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
