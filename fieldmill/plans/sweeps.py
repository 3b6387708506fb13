"""Registered queries: sweeps, run logs, model comparison files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.receipt import SYNTHETIC_SCHEMA
from fieldmill.operators.scoring import score, summarize
from fieldmill.operators.sweeps import (
    best_checkpoint,
    expand_runs,
    latest_run,
    rank_runs,
    retain_last,
    sweep_results,
    with_grid,
    with_place,
    with_runs,
)
from fieldmill.plans.base import (
    RECEIPTS,
    answers,
    answers_sql,
    query,
    receipts,
    scored_sql,
    table,
    with_answer,
    with_sql,
)
from fieldmill.plans.scoring import SUMMARY
from fieldmill.registry import open_dataset, register_dataset
from fieldmill.session import work_folder
from fieldmill.sources.samples import read_predictions, write_predictions, write_results

FIXED = {"train.max_steps": 30, "model.rank": 4}
GRID = {"model.rank": [8, 16], "model.alpha": [16, 32]}
VARIANTS = [{"label": "plain"}, {"model.weighted": True, "model.alpha": 64}]

_RUNS = """
runs AS (
  SELECT v * 4 + a * 2 + b AS run_no,
    CASE v WHEN 0 THEN 'plain' ELSE 'model.weighted=True+model.alpha=64' END AS label,
    [8, 16][a + 1]::VARCHAR AS r,
    CASE v WHEN 0 THEN [16, 32][b + 1]::VARCHAR ELSE '64' END AS alpha,
    CASE v WHEN 0 THEN '' ELSE ';model.weighted=true' END AS own
  FROM (SELECT unnest(range(2)) AS v), (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b)
)"""


@query(
    "expand_runs",
    with_sql(_RUNS)
    + """ SELECT run_no, label, 'model.alpha=' || alpha || ';model.rank=' || r || own
        || ';train.max_steps=30' AS overrides,
      count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders, runs GROUP BY ALL""",
)
def expand_runs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order once per run of a sweep, with the run's label and merged overrides."""
    rows = with_runs(
        table(spark, sf_dir, "orders").select("o_orderkey"), GRID, VARIANTS, FIXED
    )
    text = F.array_join(
        F.array_sort(
            F.transform(
                F.map_entries("overrides"), lambda e: F.concat_ws("=", e["key"], e["value"])
            )
        ),
        ";",
    )
    runs = expand_runs(spark, GRID, VARIANTS, FIXED)
    counts = rows.groupBy("run_no").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
    return counts.join(runs, "run_no").select(
        F.col("run_no").cast("bigint").alias("run_no"),
        "label",
        text.alias("overrides"),
        "rows",
        "keys",
    )


@query(
    "expand_grid",
    """SELECT combo_no, 'p_size=' || size || ',p_type="' || kind || '"' AS combo, count(*) AS rows
    FROM part, (SELECT unnest(range(6)) AS combo_no, unnest([1, 1, 1, 10, 10, 10]) AS size,
      unnest(['ECONOMY', 'SMALL', 'LARGE', 'ECONOMY', 'SMALL', 'LARGE']) AS kind)
    WHERE p_size >= size GROUP BY ALL""",
)
def expand_grid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part once per grid point it satisfies."""
    grid = {"p_size": [1, 10], "p_type": ["ECONOMY", "SMALL", "LARGE"]}
    rows = with_grid(table(spark, sf_dir, "part").select("p_size"), grid)
    kept = rows.where(F.col("p_size") >= F.element_at("combo", "p_size").cast("int"))
    text = F.array_join(
        F.transform(F.map_entries("combo"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
    )
    return kept.groupBy(
        F.col("combo_no").cast("bigint").alias("combo_no"), text.alias("combo")
    ).agg(F.count("*").alias("rows"))


SWEEP_GRID = {"model.rank": [8, 16]}
SWEEP_VARIANTS = [{"label": "plain"}, {"label": "weighted", "model.weighted": True}]
_SWEEP = with_sql(
    RECEIPTS,
    """run_rows AS (
      SELECT *, run_no::VARCHAR AS salt FROM receipts, (SELECT unnest(range(4)) AS run_no))""",
    answers_sql("salt", "run_rows"),
    scored_sql("answers", 'run_no, "index"'),
    f"sums AS (SELECT run_no, {SUMMARY} FROM scored GROUP BY run_no)",
)


def sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of the sweep answered and scored by one job."""
    rows = with_runs(receipts(spark, sf_dir), SWEEP_GRID, SWEEP_VARIANTS)
    answered = with_answer(rows, F.col("run_no").cast("string")).select(
        "run_no", F.col("target_json").alias("gold"), "raw"
    )
    sums = summarize(score(answered, schema=SYNTHETIC_SCHEMA), "run_no")
    return sums.withColumn("run_id", F.format_string("run-%03d", "run_no"))


@query(
    "sweep_rank",
    _SWEEP
    + """ SELECT run_no, ['plain', 'weighted'][run_no // 2 + 1] AS variant, ['8', '16'][run_no % 2 + 1] AS rank,
      field_f1, exact_match, json_valid_rate, schema_valid_rate,
      'run-' || lpad(run_no::VARCHAR, 3, '0') AS run_id,
      row_number() OVER (ORDER BY field_f1 DESC, run_no) AS place FROM sums""",
)
def sweep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's result table, best run first, written as CSV and read back."""
    runs = expand_runs(spark, SWEEP_GRID, SWEEP_VARIANTS)
    results = sweep_results(runs, sweep_metrics(spark, sf_dir), SWEEP_GRID, variants=True)
    place = work_folder(spark, "sweep")
    write_results(with_place(rank_runs(results)), place)
    schema = (
        "run_no bigint, variant string, rank string, field_f1 double, exact_match double, "
        "json_valid_rate double, schema_valid_rate double, run_id string, place bigint"
    )
    return spark.read.schema(schema).option("header", True).csv(place)


# Events as a training log: user = run, event = step, value = loss.


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.col("value").alias("eval_loss"),
        "event_type",
    )


@query(
    "best_checkpoint",
    """SELECT user_id AS run_id, event_id AS step, value AS eval_loss FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1""",
)
def best_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_checkpoint(run_log(spark, sf_dir))


@query(
    "best_checkpoint_max",
    """SELECT user_id AS run_id, event_id AS step, value AS eval_loss FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
)
def best_checkpoints_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_checkpoint(run_log(spark, sf_dir), greater_is_better=True)


@query(
    "retain_last",
    """SELECT user_id AS run_id, event_id AS step FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2""",
)
def retain_last_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retain_last(run_log(spark, sf_dir), 2).select("run_id", "step")


@query(
    "latest_run",
    """SELECT max('run-' || lpad(event_id::VARCHAR, 12, '0')) AS run_id FROM events
    WHERE event_type = 'purchase'""",
)
def latest_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run by name among those that saved an adapter."""
    runs = run_log(spark, sf_dir).select(
        F.format_string("run-%012d", "step").alias("run_id"),
        (F.col("event_type") == "purchase").alias("has_adapter"),
    )
    return latest_run(runs).select("run_id")


@query(
    "write_read_predictions",
    with_sql(RECEIPTS, answers_sql(), scored_sql())
    + """ SELECT "index", gold, raw, json_valid, printf('%.4f', f1)::DOUBLE AS field_f1,
      NULL::VARCHAR AS bad_reason FROM scored""",
)
def predictions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored predictions written as JSON lines and read back strictly."""
    place = work_folder(spark, "predictions")
    write_predictions(score(answers(spark, sf_dir), schema=SYNTHETIC_SCHEMA), place)
    return read_predictions(spark, place)


@register_dataset("order_receipts")
def _order_receipts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = receipts(spark, sf_dir).select("split", "index", "target_json")
    return {s: rows.where(F.col("split") == s) for s in ("train", "validation")}


@query(
    "open_dataset",
    with_sql(RECEIPTS)
    + """ SELECT split, count(*) AS rows, sum(length(target_json))::BIGINT AS chars
    FROM receipts GROUP BY split""",
)
def open_dataset_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset opened by name, queried through its published views."""
    open_dataset(spark, "order_receipts", sf_dir=sf_dir)
    return spark.sql(
        """SELECT split, count(*) AS rows, sum(length(target_json)) AS chars FROM (
          SELECT * FROM order_receipts_train UNION ALL SELECT * FROM order_receipts_validation)
        GROUP BY split"""
    )

