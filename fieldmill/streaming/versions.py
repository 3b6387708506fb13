"""A table that a stream keeps up to date, in versions that readers see whole or not at all.

Every micro-batch writes the rows that changed as one part.  A version is a list of parts; it is
there once its commit record is, which is written last and is one file.  Of rows with the same
key the one from the newest part counts.  From time to time the parts are merged into one, and
versions that are no longer kept are removed with the parts that only they name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmill.streaming.first_samples import state_store

#: Versions that readers may still be at.
RETAIN = 3
#: Parts of a version from which on they are merged.
MOST_PARTS = 8
_COMMIT = "version long, parts array<string>, keys array<string>"
_FROM = "_version"


def commits(spark: SparkSession, path: str) -> list:
    """The commit records in order, some more than RETAIN at most."""
    try:
        records = spark.read.schema(_COMMIT).json(f"{path}/commits/*")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return records.orderBy("version").collect()


def _newest_rows(spark: SparkSession, path: str, parts: list[str], keys: list[str]) -> DataFrame:
    """One row per key: the one of the newest part."""
    rows = spark.read.parquet(*[f"{path}/{part}" for part in parts])
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), _FROM).alias("row"))
    return newest.select("row.*")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest committed version, or the one asked for while it is kept."""
    found = [c for c in commits(spark, path) if version is None or c.version == version]
    if not found:
        raise ValueError(f"no such version: {path}" + ("" if version is None else f" {version}"))
    return _newest_rows(spark, path, found[-1].parts, found[-1]["keys"]).drop(_FROM)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def commit_changes(
    changed: DataFrame,
    version: int,
    path: str,
    keys: list[str],
    retain: int = RETAIN,
    most_parts: int = MOST_PARTS,
) -> None:
    """Adds a version in which the rows ``changed`` replace those of their keys.

    A version that is committed already is left as it is, so a batch may come again; one that
    was broken off is written anew.  Without changed rows there is no new version.
    """
    spark = changed.sparkSession
    known = commits(spark, path)
    if any(record.version >= version for record in known):
        return
    part = f"parts/{version:012d}"
    changed.withColumn(_FROM, F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}/{part}")
    if known and spark.read.parquet(f"{path}/{part}").isEmpty():
        return
    parts = [*(known[-1].parts if known else []), part]
    full = len(parts) > most_parts
    if full:
        merged = f"{part}-merged"
        _newest_rows(spark, path, parts, keys).write.mode("overwrite").parquet(f"{path}/{merged}")
        parts = [merged]
    record = spark.createDataFrame([(version, parts, keys)], _COMMIT).coalesce(1)
    record.write.mode("overwrite").json(f"{path}/commits/{version:012d}")
    kept = [*known, None][-retain:-1] if retain > 1 else []
    live = {*parts, *(name for old in kept for name in old.parts)}
    for old in known[: len(known) - len(kept)]:
        _remove(spark, f"{path}/commits/{old.version:012d}")
        for name in set(old.parts) - live:
            _remove(spark, f"{path}/{name}")
    if full:
        _remove(spark, f"{path}/{part}")


def publish_changes(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    retain: int = RETAIN,
    most_parts: int = MOST_PARTS,
) -> StreamingQuery:
    """Starts an update-mode query whose rows become versions of a table with one row per key; it
    handles all input available now."""

    def write(rows: DataFrame, batch: int) -> None:
        if "closed" in rows.columns:  # a step that changes and closes in one batch comes twice
            last = F.max_by(F.struct(*rows.columns), "closed").alias("row")
            rows = rows.groupBy(*keys).agg(last).select("row.*")
        commit_changes(rows, batch, path, keys, retain, most_parts)

    with state_store(stream.sparkSession):
        return (
            stream.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
