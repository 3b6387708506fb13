from __future__ import annotations

import hashlib

import pytest
from pyspark.errors import SparkRuntimeException

from fieldmill.operators.comparison import MEASURES, POISSON, compare_paired

SCHEMA = "index long, gold_valid boolean, json_valid boolean, schema_valid boolean, exact_match boolean, f1_millionths long"


def rows(count, shift):
    return [(i, i != 3, i % 2 == 0, i % 3 == shift, i % 5 == shift, (i * 37 + shift * 100_000) % 1_000_001) for i in range(count)]


def test_paired_differences_beside_plain_sums(spark):
    base, tuned = rows(60, 0), rows(60, 1)
    got = compare_paired(
        spark.createDataFrame(base, SCHEMA).repartition(3), spark.createDataFrame(tuned, SCHEMA), replicates=20, level=0.8, seed=3
    ).collect()
    kept = [i for i in range(60) if i != 3]

    def weights(replicate):
        block, at = divmod(replicate, 8)
        text = (hashlib.md5(f"bootstrap-3|{i}|{block}|0".encode()).hexdigest() for i in kept)
        return [sum(int(t[4 * at : 4 * at + 4], 16) >= bound for bound in POISSON) for t in text]

    for row in got:
        column = 2 + ["json_valid", "schema_valid", "exact_match", "f1_millionths"].index(MEASURES[row.metric])
        scale = 1 if column == 5 else 1_000_000
        b, a = ([side[i][column] * scale for i in kept] for side in (base, tuned))
        changes = sorted(
            sum(w * (y - x) for w, x, y in zip(ws, b, a)) / sum(ws) / 1e6 for ws in map(weights, range(20))
        )
        assert row.n == 59
        assert (row.baseline, row.adapter) == pytest.approx((sum(b) / 59e6, sum(a) / 59e6), abs=1e-6)
        assert (row.low, row.high) == pytest.approx((changes[2], changes[17]), abs=1e-6)
    assert {row.metric for row in got} == set(MEASURES)


def test_rows_must_be_the_same(spark):
    base, other = spark.createDataFrame(rows(9, 0), SCHEMA), spark.createDataFrame(rows(8, 0), SCHEMA)
    with pytest.raises(SparkRuntimeException):
        compare_paired(base, other).collect()
    with pytest.raises(SparkRuntimeException):
        compare_paired(base, base.union(base.limit(1))).collect()
    with pytest.raises(ValueError):
        compare_paired(base, base, replicates=1)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert compare_paired(none, none).collect() == []
