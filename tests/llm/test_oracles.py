"""Queries that SQL can express, against DuckDB."""

import pytest

from detlake.llm.queries import ORACLES, QUERIES

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    theirs = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    order = lambda row: [(x is None, x) for x in row]
    assert theirs and sorted(map(tuple, df.select(cols).collect()), key=order) == sorted(theirs, key=order)
