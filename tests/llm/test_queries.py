import pytest

from pagelens.llm import queries
from tests.oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(queries.oracle_sql()[name], SF)
