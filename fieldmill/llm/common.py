"""What the operators share: column hygiene, written tables, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.session import work_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns that an operator is about to add, whatever their case."""
    taken = {name.lower() for name in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as ``doc_id`` and the text as ``text``, with the empty text for null."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared work folder, read back.

    This cuts the lineage: a lost executor costs a read, not the work before.  The
    shuffle files of the writing job are dropped as soon as the table is complete.
    """
    spark = df.sparkSession
    place = work_folder(spark, purpose)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(place)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(place)


def filtered(docs: DataFrame, make: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text a predicate keeps, all columns as they are; no shuffle.

    ``make`` builds the predicate once per task; null texts are asked about as empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in stretches(batches):
            kept = [keep(text or "") for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def keeping(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone``, all columns as they are.

    Rows with a null id stay.  ``gone`` grows with the documents, so both sides are shuffled
    whatever its size.
    """
    number = F.col("doc_id").cast("long")
    ids = gone.select(number.alias("__gone")).distinct().hint("merge")
    every = [F.col(f"`{c}`") for c in docs.columns]
    return docs.join(ids, number == F.col("__gone"), "left_anti").select(*every)


def share_of(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(codes.size + 2, np.int8)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def chunks(ids: list, values: list[str], size: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    """Cuts a batch of texts into runs of about ``size`` characters; no text is cut."""
    begin = held = 0
    for at, value in enumerate(values):
        held += len(value) + 64
        if held >= size:
            yield ids[begin : at + 1], values[begin : at + 1]
            begin, held = at + 1, 0
    if begin < len(values):
        yield ids[begin:], values[begin:]


def stretches(
    batches: Iterator[pa.RecordBatch], size: int = 1 << 22, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``size`` bytes of text; no text is cut."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        held = np.cumsum(lengths.astype(np.int64) + 64)
        begin = 0
        while begin < batch.num_rows:
            before = held[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(held, before + size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def release() -> None:
    """Gives back what a task no longer needs: a worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)
