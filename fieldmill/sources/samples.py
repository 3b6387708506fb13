"""Reading samples, predictions and pairs; writing predictions, pairs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmill.functions.receipt import (
    DEFAULT_EVAL,
    DEFAULT_TRAIN,
    EVAL_START,
    IMAGE_SIZE,
    minify_json,
    with_receipt,
)
from fieldmill.functions.strict_json import normalize_annotation, parse_json
from fieldmill.functions.text import round4
from fieldmill.operators.pairs import PAIR_TYPE, first_n
from fieldmill.registry import register_dataset

SAMPLE_COLUMNS = {
    "index": "index",
    "split": "split",
    "image_ref": "image_ref",
    "ground_truth": "ground_truth",
}


#: Rows a task gets at most where each row costs much, as drawing, answering and scoring do.
ROWS_PER_TASK = 20_000


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks for so many costly rows: no more than ROWS_PER_TASK in one, no core without one."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A scan with fewer partitions than cores is spread out before row-heavy work.

    Big inputs already have many partitions and pass through unchanged.  A scan is cut by bytes
    and by row groups, so a narrow table gives tasks that grow with it; where ``rows``, the number
    of its rows, is given, no task gets more than ROWS_PER_TASK of them.
    """
    wanted = task_count(df.sparkSession, rows or 0)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def read_samples(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    limit: int | None = None,
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """One split of an annotated dataset: only the contract's columns are read.

    ``columns`` maps contract names to the source's own.  The split is a plain
    filter on the source column, so the scan prunes by it; ``limit`` takes the first rows
    by index, min(limit, rows), and 0 is empty.
    """
    names = {**SAMPLE_COLUMNS, **(columns or {})}
    rows = spark.read.parquet(path)
    if split is not None:
        rows = rows.where(F.col(names["split"]) == split)
    return first_n(rows, limit, names["index"]).select(
        *[F.col(source).alias(name) for name, source in names.items()]
    )


def normalized(samples: DataFrame) -> DataFrame:
    """Annotated samples with ``target_json``; ``bad_reason`` where there can be none."""
    return samples.withColumn("_n", normalize_annotation(F.col("ground_truth"))).select(
        *[c for c in samples.columns if c != "ground_truth"], "_n.*"
    )


def generate_receipts(seeds: DataFrame, key: str = "index", seed: int = 0) -> DataFrame:
    """One labelled synthetic receipt per seed row; every row depends on its key alone."""
    width, height = IMAGE_SIZE
    return with_receipt(seeds, key, seed).withColumns(
        {
            # never null, and declared so: a filter for rows with a target costs nothing
            "target_json": F.coalesce(minify_json(F.col("receipt")), F.lit("null")),
            "width": F.lit(width),
            "height": F.lit(height),
        }
    )


def synthetic_splits(
    spark: SparkSession, n_train: int | None = None, n_eval: int | None = None, seed: int = 0
) -> DataFrame:
    """Train and held-out receipts from disjoint seed ranges; None means the default size."""
    n_train = DEFAULT_TRAIN if n_train is None else n_train
    n_eval = DEFAULT_EVAL if n_eval is None else n_eval
    if n_train > EVAL_START:
        raise ValueError(f"more than {EVAL_START} train rows would reach the held-out seeds")

    def side(split: str, start: int, n: int) -> DataFrame:
        return spark.range(start, start + n).select(
            F.lit(split).alias("split"),
            (F.col("id") - start).alias("index"),
            F.col("id").alias("seed"),
        )

    seeds = side("train", 0, n_train).unionByName(side("validation", EVAL_START, n_eval))
    return generate_receipts(seeds, "seed", seed)


@register_dataset("synthetic_invoices")
def _synthetic(
    spark: SparkSession, n_train: int | None = None, n_eval: int | None = None
) -> dict[str, DataFrame]:
    rows = synthetic_splits(spark, n_train, n_eval)
    return {name: rows.where(F.col("split") == name) for name in ("train", "validation")}


@register_dataset("cord")
def _annotated(
    spark: SparkSession,
    path: str,
    train_split: str = "train",
    eval_split: str = "validation",
    n_train: int | None = None,
    n_eval: int | None = None,
    columns: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    return {
        "train": normalized(read_samples(spark, path, train_split, n_train, columns)),
        "validation": normalized(read_samples(spark, path, eval_split, n_eval, columns)),
    }


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count("*").alias("rows"))


def preview(samples: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` targets of each split, with the split's row count and columns."""
    counts = split_counts(samples).withColumn("columns", F.lit(",".join(samples.columns)))
    return first_n(samples, n, by="split").select("split", "index", "target_json").join(counts, "split")


_PREDICTION_KEYS = ("index", "gold", "raw", "json_valid", "field_f1")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lines: ``index, gold, raw, json_valid, field_f1, bad_reason``.

    Lines are parsed strictly, so ``gold`` keeps its key order as minified text.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_prediction_lines(lines)


def parse_prediction_lines(lines: DataFrame) -> DataFrame:
    """Works on batches and streams of ``value`` lines alike."""
    kept = [c for c in lines.columns if c != "value"]
    members = lines.withColumn("_members", parse_json(F.col("value"), "members")["members"])
    cells = members.withColumn(
        "_cells",
        F.map_from_entries(
            F.filter(
                F.coalesce(
                    "_members", F.array().cast("array<struct<key:string,value:string>>")
                ),
                lambda m: m["key"].isin(*_PREDICTION_KEYS),
            )
        ),
    )

    def cell(key: str) -> Column:
        return F.element_at("_cells", key)

    def text(key: str) -> Column:
        return F.element_at(
            F.from_json(F.concat(F.lit("["), cell(key), F.lit("]")), "array<string>"), 1
        )

    return cells.select(
        *kept,
        cell("index").try_cast("bigint").alias("index"),
        cell("gold").alias("gold"),
        text("raw").alias("raw"),
        F.coalesce(cell("json_valid") == "true", F.lit(False)).alias("json_valid"),
        F.coalesce(cell("field_f1").try_cast("double"), F.lit(0.0)).alias("field_f1"),
        F.when(F.col("_members").isNull(), "not a JSON object")
        .when(cell("index").try_cast("bigint").isNull(), "no index")
        .alias("bad_reason"),
    )


def write_predictions(
    scored: DataFrame, path: str, mode: str = "error", by: tuple[str, ...] = ()
) -> None:
    """Scored rows as JSON lines; gold and prediction stay JSON objects, in key order.

    ``by`` (a run, say) becomes one folder per value; readers get it back as a column.
    """
    prediction = parse_json(F.col("raw"), "minified", block=True)["minified"]
    gold = parse_json(F.col("gold"), "minified")["minified"]
    flags = F.to_json(
        F.struct(
            "raw", "json_valid", "schema_valid", round4(F.col("field_f1")).alias("field_f1")
        ),
        {"ignoreNullFields": "false"},
    )
    line = F.concat(
        F.lit('{"index":'), F.col("index").cast("string"),
        F.lit(',"gold":'), F.coalesce(gold, F.lit("null")),
        F.lit(',"pred":'), F.coalesce(prediction, F.lit("null")),
        F.lit(","), F.substring(flags, F.lit(2), F.length(flags) - 1),
    )
    scored.select(*by, line.alias("value")).write.mode(mode).partitionBy(*by).text(path)


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    pairs.select("split", "index", "chosen", "rejected").write.mode(mode).option(
        "ignoreNullFields", "false"
    ).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair lines; blank lines are skipped, a line that is no pair fails the job."""
    schema = T.StructType.fromDDL(PAIR_TYPE)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "error") -> None:
    metrics.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """The sweep's result table as CSV with a header."""
    results.write.mode(mode).option("header", True).csv(path)
