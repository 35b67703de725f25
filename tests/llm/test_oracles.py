import pytest

from tests.oracle import agree
from textloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, medium, name):
    agree(registry.queries()[name](spark, medium), registry.oracle_sql()[name], medium)
