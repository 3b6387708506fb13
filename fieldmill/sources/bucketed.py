"""Predictions and golds as bucketed tables, for joins that come again and again.

A table is written once, hashed and sorted by its key; every later ``zip_strict`` of two such
tables reads bucket beside bucket and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.operators.scoring import zip_strict


def write_bucketed(
    df: DataFrame, name: str, on: str = "index", buckets: int | None = None,
    path: str | None = None, mode: str = "error",
) -> DataFrame:
    """``df`` as table ``name``, one sorted file per bucket of ``on``, read back.

    Without a number there are as many buckets as the session shuffles into.  Tables that are
    to be zipped need the same number.  ``path`` makes it an external table, say in the shared
    folder.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets < 1:
        raise ValueError("a table needs a bucket")
    # the same hash as the buckets', so each task writes one file instead of one per bucket
    writer = df.repartition(buckets, F.col(on)).write.format("parquet").mode(mode)
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, on).sortBy(on).saveAsTable(name)
    return spark.table(name)


def bucketing(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    """Number of buckets and bucket columns of a table; (0, []) without any."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name IN ('Num Buckets', 'Bucket Columns')")
    found = {row.col_name: row.data_type for row in rows.collect()}
    columns = found.get("Bucket Columns", "[]").strip("[]")
    return int(found.get("Num Buckets", 0)), [c.strip().strip("`") for c in columns.split(",") if c.strip()]


def zip_bucketed(spark: SparkSession, preds: str, golds: str, on: str = "index") -> DataFrame:
    """``zip_strict`` of two tables of ``write_bucketed``, without a shuffle on either side.

    Tables that would need one are refused, so that the promise cannot fail unseen.
    """
    left, right = bucketing(spark, preds), bucketing(spark, golds)
    if left != right or left[1] != [on]:
        raise ValueError(f"{preds} and {golds} are not bucketed alike by {on}: {left}, {right}")
    return zip_strict(spark.table(preds), spark.table(golds), on)
