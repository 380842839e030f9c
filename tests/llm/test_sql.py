import pytest

from oracle import assert_equals_sql
from touchline.llm.queries import SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, small, name):
    assert_equals_sql(spark, small, name)
