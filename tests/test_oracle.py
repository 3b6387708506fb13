"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, rows_of
from fieldmill.plans import registered

# the queries of the package itself; those of its optional subpackage have tests of their own
QUERIES, ORACLES = (
    {name: entry_points.queries()[name] for name in registered()[0]},
    registered()[1],
)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    assert mine
    if name in ORACLES:
        result = tables.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names)
        assert mine == rows_of(names, result.fetchall())


def test_flagship(spark):
    assert entry_points.entry(spark).first().n > 0
