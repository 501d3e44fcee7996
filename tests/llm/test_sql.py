"""Queries with SQL give the rows that DuckDB gives."""

import pytest
from compare import both

from cuelight.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, small, name):
    ours, theirs = both(spark, small, queries.queries()[name], queries.oracle_sql()[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
