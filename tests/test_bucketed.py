"""Bucketed tables: the zip shuffles nothing and keeps every check of ``zip_strict``."""

from __future__ import annotations

import uuid

import pytest

from fieldmill.operators.scoring import zip_strict
from fieldmill.sources.bucketed import bucketing, write_bucketed, zip_bucketed


@pytest.fixture
def pair(spark, tmp_path):
    made = []

    def write(preds, golds, buckets=(4, 4), on="index"):
        names = []
        for side, rows, n in (("raw", preds, buckets[0]), ("gold", golds, buckets[1])):
            names.append(f"t_{uuid.uuid4().hex}")
            df = spark.createDataFrame(rows, f"{on} long, {side} string")
            write_bucketed(df, names[-1], on, n, str(tmp_path / names[-1]))
        made.extend(names)
        return names

    yield write
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


ROWS = [(i * 7, f"x{i}") for i in range(200)]


def test_no_exchange_on_either_side(spark, pair):
    zipped = zip_bucketed(spark, *pair(ROWS, ROWS[::-1]))
    plan = zipped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sorted((r["index"], r.raw, r.gold) for r in zipped.collect()) == [(i, t, t) for i, t in ROWS]
    final = zipped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in final


def test_one_sorted_file_per_bucket(spark, pair, tmp_path):
    names = pair(ROWS, ROWS)
    assert len(list((tmp_path / names[0]).glob("*.parquet"))) == 4
    assert bucketing(spark, names[0]) == (4, ["index"])


@pytest.mark.parametrize(
    "preds, golds, message",
    [(ROWS, ROWS[:-1], "only one side"), (ROWS[1:], ROWS, "only one side"), (ROWS + ROWS[:1], ROWS, "duplicate key")],
)
def test_the_checks_stay(spark, pair, preds, golds, message):
    with pytest.raises(Exception, match=message):
        zip_bucketed(spark, *pair(preds, golds)).collect()


def test_unlike_tables_are_refused(spark, pair):
    with pytest.raises(ValueError, match="not bucketed alike"):
        zip_bucketed(spark, *pair(ROWS, ROWS, (4, 8)))
    other = pair(ROWS, ROWS, on="place")
    with pytest.raises(ValueError, match="not bucketed alike"):
        zip_bucketed(spark, *other)


def test_same_rows_as_the_plain_zip(spark, pair):
    names = pair(ROWS, ROWS)
    plain = zip_strict(spark.table(names[0]), spark.table(names[1]))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, zip_bucketed(spark, *names).collect()))


def test_empty_tables(spark, pair):
    assert zip_bucketed(spark, *pair([], [])).count() == 0
