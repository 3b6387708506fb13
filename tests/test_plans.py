"""Physical plans: what must be in them at scale, and what must not."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fieldmill.operators.pairs import attach_samples
from fieldmill.operators.scoring import per_field, score, summarize, zip_strict
from fieldmill.operators.sweeps import expand_runs, retain_last, sweep_results, with_runs
from fieldmill.plans import registered
from fieldmill.plans.sweeps import SWEEP_GRID, SWEEP_VARIANTS, sweep_metrics
from fieldmill.sources.samples import read_samples

# The aggregate of a whole table ends in one row; a small table is ranked or limited.
ONE_ROW_OUT = {
    "field_f1_summary", "evaluate_zip", "evaluate_zip_bucketed", "match_fields_f1", "predict", "latest_run", "sweep_rank",
    "first_n_ordered", "top_norms", "dense_index", "pad_batches", "pad_batches_left", "stream_eval", "preference_rows",
}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registered()[0]))
def test_no_query_has_a_cross_join_or_one_task_over_all_rows(spark, sf_dir, name):
    plan = physical(entry_points.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ONE_ROW_OUT:
        assert "SinglePartition" not in plan, plan


def test_one_parse_per_row(spark, sf_dir):
    df = spark.createDataFrame([(0, "{}", "{}")], "index long, gold string, raw string")
    for out in (summarize(score(df)), per_field(score(df)), score(df).where("json_valid and tp > 1")):
        assert physical(out).count("ArrowEvalPython") == 1


def test_zip_needs_one_shuffle_per_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = spark.range(100).select(F.col("id").alias("index"), F.lit("{}").alias("raw"))
        right = spark.range(100).select(F.col("id").alias("index"), F.lit("{}").alias("gold"))
        plan = physical(zip_strict(left, right))
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2 and "SortMergeJoin" in plan
        pairs = spark.range(9).select(F.lit("train").alias("split"), F.col("id").alias("index"))
        samples = pairs.withColumn("image_ref", F.lit("x"))
        assert len(re.findall(r"Exchange hashpartitioning", physical(attach_samples(pairs, samples)))) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_carry_no_broadcast_hint(spark, sf_dir):
    for name in ("preference_rows", "match_fields", "prompt_lengths", "evaluate_zip"):
        df = entry_points.queries()[name](spark, sf_dir)
        assert "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_newest_rows_are_limited_before_the_shuffle(spark):
    log = spark.range(1000).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("step"))
    plan = physical(retain_last(log, 2))
    assert plan.count("WindowGroupLimit") == 2


def test_samples_are_filtered_and_pruned_in_the_scan(spark, sf_dir):
    df = read_samples(
        spark, f"{sf_dir}/documents.parquet", "en", 50,
        {"index": "doc_id", "split": "lang", "image_ref": "source", "ground_truth": "text"},
    )
    plan = physical(df.select("index"))
    assert "EqualTo(lang,en)" in plan and "TakeOrderedAndProject(limit=50" in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string>", plan)


def test_runs_multiply_inside_the_task(spark):
    plan = physical(with_runs(spark.range(10), {"a": [1, 2]}, [{}, {"b": 1}]))
    assert "Exchange" not in plan and "Join" not in plan


def test_targets_are_rendered_once(spark, sf_dir):
    for name in ("pairs_from_gold", "preference_rows"):
        df = entry_points.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if re.search(r"\bFilter\b", line)]
        assert not any("structs" in line.lower() or "to_json" in line for line in filters), filters


def test_a_sweep_scores_every_answer_once(spark, sf_dir):
    metrics = sweep_metrics(spark, sf_dir)
    runs = expand_runs(spark, SWEEP_GRID, SWEEP_VARIANTS)
    plan = physical(sweep_results(runs, metrics, SWEEP_GRID, True))
    assert plan.count("ArrowEvalPython") == 1
