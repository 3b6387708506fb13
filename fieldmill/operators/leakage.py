"""Held-out content in the training rows, whatever the order of keys or spelling of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.strict_json import parse_json
from fieldmill.session import work_folder

#: Blocks of the filter, 4,096 bytes each: 8 MB, whatever the input.
BLOCKS = 2048
BLOCK_BITS = 4096 * 8
#: Bits a key sets, all in its own block.
BITS_PER_KEY = 3


def canonical_key(df: DataFrame, text: str) -> DataFrame:
    """(content): SHA-256 of the canonical JSON of every row with a text.

    Keys are sorted, numbers and truth values that compare equal are spelled alike, blanks
    between tokens vanish; a text that is no JSON stands for itself and is never equal to one
    that is.  NULL is no text.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))
    parsed = rows.withColumn("parsed", parse_json(F.col("text"), "canonical"))
    marked = F.when(
        F.col("parsed.valid"), F.concat(F.lit("json:"), F.col("parsed.canonical"))
    ).otherwise(F.concat(F.lit("text:"), F.col("text")))
    return parsed.select(F.unhex(F.sha2(marked, 256)).alias("content"))


def _block(content: Column) -> Column:
    return F.pmod(F.xxhash64(content), F.lit(BLOCKS)).cast("int")


def _places(content: Column) -> list[Column]:
    drawn = F.xxhash64(content, F.lit("places"))
    return [F.pmod(F.shiftrightunsigned(drawn, 16 * i), F.lit(BLOCK_BITS)) for i in range(BITS_PER_KEY)]


def block_filter(keys: DataFrame) -> DataFrame:
    """(block, bits): a Bloom filter of the contents in blocks, at most BLOCKS rows of 4 kB."""
    places = F.explode(F.array(*_places(F.col("content")))).alias("place")
    return (
        keys.select(_block(F.col("content")).alias("block"), places)
        .groupBy("block")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )


def maybe_held(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows whose content the filter cannot rule out; none that it holds is lost."""

    def is_set(place: Column) -> Column:
        byte = F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
        return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(
            F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8 + 1).cast("int"))
        ) > 0

    met = rows.withColumn("block", _block(F.col("content"))).join(F.broadcast(blocks), "block")
    for place in _places(F.col("content")):
        met = met.where(is_set(place))
    return met.select(*rows.columns)


def canonical_leakage(train: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """(content, n_train, n_eval): canonical contents that both sides hold.

    The held-out side is counted once and kept as a table; its filter goes to every task of
    the training side, so only rows that may leak are shuffled.  With more held-out contents
    than the filter tells apart it lets more through and the result stays the same.  Counts
    are combined before each shuffle: a content with very many copies costs one row a task.
    """
    spark = train.sparkSession
    place = work_folder(spark, "held-out-contents")
    counted = canonical_key(held_out, text).groupBy("content").agg(F.count("*").alias("n_eval"))
    counted.write.parquet(place)
    counted = spark.read.schema(counted.schema).parquet(place)
    found = maybe_held(canonical_key(train, text), block_filter(counted))
    return (
        found.groupBy("content")
        .agg(F.count("*").alias("n_train"))
        .join(counted, "content")
        .select(F.lower(F.hex("content")).alias("content"), "n_train", "n_eval")
    )
