import pytest

from tests.oracle import agree
from textloom import catalog

WITH_SQL = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, medium, name):
    agree(catalog.queries()[name](spark, medium), catalog.oracle_sql()[name], medium)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(WITH_SQL)))
def test_runs(spark, small, name):
    rows = catalog.queries()[name](spark, small).count()
    assert rows > 0 or name == "tag_code_copyright_comments_v1"  # there is no code in the tables
