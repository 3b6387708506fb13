"""Predictions that arrive as a stream: scores per training step, hard pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmill.functions.text import round4
from fieldmill.operators.pairs import pairs_from_predictions
from fieldmill.operators.scoring import RATES, score, summarize

PREFIX = "gen_"


def stream_eval(
    stream: DataFrame,
    schema: dict | None = None,
    by: tuple[str, ...] = ("run_id", "step"),
    n_samples: int | None = None,
) -> DataFrame:
    """Rates per run and step while ``(run_id, step, index, gold, raw)`` rows arrive.

    Rows are scored as in a batch job; the only state is one row of sums per step.
    ``n_samples`` keeps the first indexes of each evaluation.
    """
    rows = stream if n_samples is None else stream.where(F.col("index") < n_samples)
    summary = summarize(score(rows, schema=schema), *by)
    return summary.select(
        *by,
        "n",
        "n_json_valid",
        "n_schema_valid",
        "n_exact_match",
        "f1_millionths",
        *[F.col(rate).alias(PREFIX + rate) for rate in RATES],
    )


def stream_pairs(stream: DataFrame, split: str, schema: dict | None = None) -> DataFrame:
    """Hard pairs out of arriving ``(index, gold, raw)`` rows: stateless, append only.

    The score is rounded to four decimals before the test, as stored scores are.
    """
    scored = score(stream, schema=schema).withColumn("field_f1", round4(F.col("field_f1")))
    return pairs_from_predictions(scored, split)


def drop_resent(stream: DataFrame, arrived: str, delay: str = "1 hour") -> DataFrame:
    """For producers that may send a row again: the first arrival within ``delay`` counts."""
    return stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(
        ["run_id", "step", "index"]
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts an append query into parquet files that handles all input available now."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def publish_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a complete-mode query that writes the whole table once per micro-batch.

    A batch that is run again after a failure writes the same version folder anew.
    """

    def write(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/version={batch:09d}")

    return (
        stream.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version ``publish_versions`` wrote."""
    versions = spark.read.option("basePath", path).parquet(path)
    newest = versions.agg(F.max("version").alias("version"))
    return versions.join(newest, "version", "left_semi").drop("version")
