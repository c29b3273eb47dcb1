"""Queries with SQL against DuckDB on the small tables."""

import pytest

from sparkquarry.llm import queries
from tests.conftest import SMALL
from tests.duck import same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_text_query_equals_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)
