"""Registered queries: answers that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.receipt import SYNTHETIC_SCHEMA
from fieldmill.operators.scoring import score, summarize
from fieldmill.plans.base import (
    RECEIPTS,
    answers_sql,
    query,
    receipts_of,
    scored_sql,
    with_answer,
    with_sql,
)
from fieldmill.plans.scoring import SUMMARY
from fieldmill.session import work_folder
from fieldmill.sources.samples import task_count
from fieldmill.streaming.first_samples import first_samples
from fieldmill.streaming.scoring import (
    append_to,
    drop_resent,
    publish_versions,
    read_newest,
    stream_eval,
    stream_pairs,
)
from fieldmill.streaming.versions import publish_changes, read_version


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a file stream of ``run_id, step, index, gold, raw`` rows."""
    path = f"{sf_dir}/orders.parquet"
    schema = spark.read.parquet(path).select("o_orderkey", "o_orderpriority").schema
    # A pattern, so that the table may be one file or a folder of files.
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{orders}}.parquet")
    # Key rows are small: spreading them keeps all cores busy on a few-file batch, and a batch of
    # all there is in tasks of bounded size.
    spread = orders.repartition(task_count(spark, spark.read.parquet(path).count()))
    return with_answer(receipts_of(spread)).select(
        F.col("o_orderpriority").alias("run_id"),
        ((F.col("seed") % 4 + 1) * 100).alias("step"),
        F.col("seed").alias("index"),
        F.col("target_json").alias("gold"),
        "raw",
    )


_STEPPED = with_sql(
    RECEIPTS,
    answers_sql(),
    """arrived AS (SELECT o_orderpriority AS run_id, (o_orderkey % 4 + 1) * 100 AS step, answers.*
      FROM answers JOIN orders ON o_orderkey = answers."index")""",
    scored_sql("arrived", 'run_id, step, "index"'),
)
_GEN = SUMMARY
for _rate in ("json_valid_rate", "schema_valid_rate", "field_f1", "exact_match"):
    _GEN = _GEN.replace(f" AS {_rate}", f" AS gen_{_rate}")


@query("stream_eval", f"{_STEPPED} SELECT run_id, step, {_GEN} FROM scored GROUP BY run_id, step")
def stream_eval_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per run and step, kept up to date by a streaming aggregation."""
    place = work_folder(spark, "stream-eval")
    scores = stream_eval(arriving(spark, sf_dir), SYNTHETIC_SCHEMA)
    publish_versions(scores, f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return read_newest(spark, f"{place}/table")


@query(
    "stream_hard_pairs",
    with_sql(RECEIPTS, answers_sql(), scored_sql())
    + """ SELECT 'validation' AS split, "index", gold AS chosen, raw AS rejected FROM scored
    WHERE NOT json_valid OR printf('%.4f', f1)::DOUBLE < 1""",
)
def stream_hard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of real mistakes, mined while the answers arrive."""
    place = work_folder(spark, "stream-pairs")
    pairs = stream_pairs(arriving(spark, sf_dir), "validation", SYNTHETIC_SCHEMA)
    append_to(pairs, f"{place}/pairs", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/pairs")


@query(
    "stream_scores",
    f"{_STEPPED} SELECT run_id, step, {SUMMARY} FROM scored GROUP BY run_id, step",
)
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rates from scored rows a stateless stream appended."""
    place = work_folder(spark, "stream-scores")
    scored = score(arriving(spark, sf_dir), schema=SYNTHETIC_SCHEMA).drop("gold", "raw")
    append_to(scored, f"{place}/scored", f"{place}/checkpoint").awaitTermination()
    return summarize(spark.read.parquet(f"{place}/scored"), "run_id", "step")


FIRST = 20
_FIRST = with_sql(
    RECEIPTS,
    answers_sql(),
    f"""first AS (SELECT o_orderpriority AS run_id, (o_orderkey % 4 + 1) * 100 AS step, answers.*
      FROM answers JOIN orders ON o_orderkey = answers."index"
      QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY answers."index") <= {FIRST})""",
    scored_sql("first", 'run_id, step, "index"'),
)


@query("stream_first_n", f"{_FIRST} SELECT run_id, step, {SUMMARY} FROM scored GROUP BY run_id, step")
def stream_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the first samples of every step, kept as versions of one table."""
    place = work_folder(spark, "stream-first")
    rows = first_samples(arriving(spark, sf_dir), FIRST, SYNTHETIC_SCHEMA).drop("closed")
    publish_changes(rows, f"{place}/table", f"{place}/checkpoint", ["run_id", "step"]).awaitTermination()
    return read_version(spark, f"{place}/table")


@query(
    "stream_resent",
    f"{_STEPPED} SELECT run_id, step, {SUMMARY} FROM scored GROUP BY run_id, step",
)
def stream_resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth answer is sent again ten minutes later and still counts once."""
    place = work_folder(spark, "stream-resent")
    again = F.when(F.col("index") % 5 == 0, F.array(F.lit(0), F.lit(600))).otherwise(F.array(F.lit(0)))
    sent = arriving(spark, sf_dir).withColumn("delay", F.explode(again))
    sent = sent.withColumn("arrived", F.timestamp_seconds(F.col("index") + F.col("delay"))).drop("delay")
    scored = score(drop_resent(sent, "arrived"), schema=SYNTHETIC_SCHEMA).drop("gold", "raw")
    append_to(scored, f"{place}/scored", f"{place}/checkpoint").awaitTermination()
    return summarize(spark.read.parquet(f"{place}/scored"), "run_id", "step")
