"""The queries with SQL beside it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import rows_of
from fieldmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = entry_points.queries()[name](spark, sf_dir)
    result = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_every_query_is_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())
