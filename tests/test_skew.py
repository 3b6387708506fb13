"""Inputs where one key holds a third of all rows."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from fieldmill.operators.batching import dense_index, prompt_len_lookup
from fieldmill.operators.pairs import attach_samples
from fieldmill.operators.scoring import key_counts, leakage, match_fields
from fieldmill.operators.sweeps import best_checkpoint, retain_last
from fieldmill.operators.vectors import group_norms

N = 30_000


@contextmanager
def settings(spark, **values):
    names = {k.replace("_", "."): v for k, v in values.items()}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


@pytest.fixture
def hot(spark):
    """``key`` 0 holds a third of the rows."""
    return spark.range(N).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    query.executedPlan().execute().count()
    return query.executedPlan().toString()


def test_match_of_a_giant_document(spark, hot):
    rows = hot.select(F.col("key").alias("index"), F.lit("menu[].name").alias("path"), F.col("id").cast("string").alias("value"))
    got = match_fields(rows.where("value % 2 = 0").union(rows.limit(5)), rows).where("index = 0").first()
    assert (got.field, got.tp + got.fn) == ("menu", N // 3)
    with settings(spark, spark_sql_adaptive_coalescePartitions_enabled="false"):
        cells = rows.groupBy("index", "path", "value").count()
        sizes = [r[1] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < N / 3


def test_popular_sample_is_split(spark, hot):
    pairs = hot.select(F.lit("train").alias("split"), F.col("key").alias("index"), F.repeat(F.lit("x"), 200).alias("chosen"), "id")
    samples = spark.range(N).select(F.lit("train").alias("split"), F.col("id").alias("index"), F.lit("img").alias("image_ref"))
    with settings(
        spark,
        spark_sql_autoBroadcastJoinThreshold="-1",
        spark_sql_adaptive_autoBroadcastJoinThreshold="-1",
        spark_sql_adaptive_skewJoin_skewedPartitionThresholdInBytes="20000",
        spark_sql_adaptive_skewJoin_skewedPartitionFactor="1.5",
        spark_sql_adaptive_advisoryPartitionSizeInBytes="20000",
    ):
        joined = attach_samples(pairs.repartition(20), samples)
        assert "isSkew=true" in final_plan(joined) or "skew=true" in final_plan(joined)
        assert joined.where("bad_reason is null").count() == N
        assert joined.select("id").distinct().count() == N


def test_popular_size_is_salted(spark, hot):
    rows = hot.withColumnRenamed("key", "width").withColumn("height", F.lit(1))
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1", spark_sql_adaptive_autoBroadcastJoinThreshold="-1",
                  spark_sql_adaptive_coalescePartitions_enabled="false"):
        got = prompt_len_lookup(rows, ["width", "height"], F.col("width") + 7)
        assert got.count() == N and got.where("prompt_len <> width + 7").count() == 0
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < N / 3


def test_copies_and_long_runs(spark, hot):
    texts = hot.select(F.col("key").cast("string").alias("t"))
    found = leakage(texts, spark.createDataFrame([("0",)], "t string"), "t").first()
    assert (found.n_train, found.n_eval) == (N // 3, 1)
    log = hot.select(F.col("key").alias("run_id"), F.col("id").alias("step"), (-F.col("id")).cast("double").alias("eval_loss"))
    assert [r.step for r in retain_last(log, 2).where("run_id = 0").orderBy("step").collect()] == [N - 6, N - 3]
    assert best_checkpoint(log).where("run_id = 0").first().step == N - 3
    vectors = hot.select("key", F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    assert group_norms(vectors, "key", "v").where("key = 0").first().norm == pytest.approx(5 * (N / 3) ** 0.5)


def test_dense_index_over_a_hot_first_column(spark, hot):
    with settings(spark, spark_sql_adaptive_coalescePartitions_enabled="false"):
        indexed = dense_index(hot, "key", "id")
    assert len(indexed.inputFiles()) > 2
    rows = indexed.collect()
    assert sorted(r["index"] for r in rows) == list(range(N))
    assert [r.id for r in sorted(rows, key=lambda r: r["index"])[:3]] == [0, 3, 6]


def test_frequent_field_is_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.array(F.lit("1:a1")).alias("gold_fields"), F.array(F.lit("1:a1")).alias("pred_fields"))
    plan = key_counts(df).groupBy("field").agg(F.sum("tp"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
