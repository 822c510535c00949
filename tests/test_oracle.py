import pytest

from pagelens.plans import registry
from tests.oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = spark_rows(registry.queries()[name](spark, SF))
    want = sql_rows(registry.oracle_sql()[name], SF)
    assert len(got) == len(want)
    assert got == want
