"""Nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and names the signed axis that comes nearest.  Every table holds every
vector in the bucket of its axes; a query looks into the few buckets of each table whose axes
come nearest to it.  The vectors of a bucket and the queries that probe it meet in one task, where
the cosines are computed exactly, and only the best of each query leave it.

Equal vectors are one entry of the index, with as many ids as an answer can need, and equal
queries ask once; large buckets are split into blocks.  So neither copies nor a dense region make
a group that grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import table, written
from fieldmill.operators.batching import dense_index

NEIGHBOURS = 5
TABLES = 16
#: Buckets that a query looks into, of the 128 that one hash of 64 dimensions has.
PROBES = 8
ROUNDS = 3
SEED = 20
#: Rows of a bucket that one block holds at most on average, and queries that meet them at once.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
#: Mean rows of a bucket from which a second hash divides the buckets.
BUCKET_ROWS = 1 << 14
#: Queries compared with all rows in one pass, where the buckets held too few.
SCAN_QUERIES = 2048
#: Copies of a query vector's row, so that equal queries find it in many tasks.
COPIES = 32

def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of every row; the width is a power of two."""
    count, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(count, -1, 2, step)
        sums, differences = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        rows = np.stack([sums, differences], 2).reshape(count, width)
        step *= 2
    return rows / math.sqrt(width)


@dataclass(frozen=True)
class Hashes:
    """The tables' pseudo-rotations: the first names one of ``2 * width`` signed axes, the second
    one of ``split`` among its first axes (1: there is no second)."""

    tables: int = TABLES
    probes: int = PROBES
    split: int = 1
    seed: int = SEED

    def _turned(self, rows: np.ndarray, number: int, part: int) -> np.ndarray:
        width = 1 << max(1, rows.shape[1] - 1).bit_length()
        turned = np.zeros((len(rows), width))
        turned[:, : rows.shape[1]] = rows
        draw = np.random.default_rng([self.seed, width, number, part])
        for _ in range(ROUNDS):
            turned = hadamard(turned * draw.choice([-1.0, 1.0], width))
        return turned

    def nearness(self, rows: np.ndarray, number: int) -> np.ndarray:
        """How near every bucket of a table comes to each row; the bucket of a row is the nearest."""
        first = self._turned(rows, number, 0)
        found = np.concatenate([first, -first], 1)
        if self.split == 1:
            return found
        half = self._turned(rows, number, 1)[:, : self.split // 2]
        second = np.concatenate([half, -half], 1)
        return (found[:, :, None] + second[:, None, :]).reshape(len(rows), -1)

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        """The bucket of every row in every table."""
        return np.stack([self.nearness(rows, t).argmax(1) for t in range(self.tables)], 1)

    def probed(self, rows: np.ndarray) -> np.ndarray:
        """The buckets of every table that a query looks into.  Where a second hash divides the
        buckets, more of them are probed, though a smaller share."""
        found = []
        for number in range(self.tables):
            near = self.nearness(rows, number)
            many = min(near.shape[1], math.ceil(self.probes * self.split**0.75))
            found.append(np.argpartition(-near, many - 1, axis=1)[:, :many])
        return np.stack(found, 1)


def hashes_for(rows: int, width: int, **given) -> Hashes:
    """Hashes whose buckets hold BUCKET_ROWS vectors on average at most, as far as the axes of a
    second hash go."""
    buckets, split = 2 * max(2, width), 1
    while rows > BUCKET_ROWS * buckets * split and split < buckets:
        split *= 2
    return Hashes(**({"split": split} | given))


def valid(vector: Column) -> Column:
    """Whether a vector takes part: it has a direction and no null or endless component."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(
        numbers,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(numbers, lambda x: x != 0)


def entries(rows: DataFrame, most: int) -> DataFrame:
    """(entry, ids, vector): one row per distinct vector of (vec_id, vector), with its ``most``
    smallest ids, numbered in the order of the smallest.

    Every task keeps so many ids per vector before the shuffle, so a vector that a third of
    the rows have is no large group.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    found = first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    found = found.withColumn("least", F.element_at("ids", 1))
    return dense_index(found, "least", "vector", name="entry").select("entry", "ids", "vector")


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for every width that occurs."""
    widths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1]
    starts = starts - (starts[0] if starts.size else 0)
    found = []
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        found.append((at, _units(flat[starts[at][:, None] + np.arange(width)])))
    return found


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square is endless or zero."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _dealt(df: DataFrame, hashes: Hashes, asking: bool) -> DataFrame:
    """Every entry once per bucket that it lies in or, as a query, looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                for at, units in _matrix(some.column("vector")):
                    found = hashes.probed(units) if asking else hashes.buckets(units)[:, :, None]
                    rows = np.repeat(at, found[0].size)
                    numbers = np.tile(np.repeat(np.arange(hashes.tables), found.shape[2]), at.size)
                    width = np.full(rows.size, units.shape[1], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(width),
                            pa.array(numbers.astype(np.int32)),
                            pa.array(found.reshape(-1).astype(np.int32)),
                            some.column("entry").take(pa.array(rows)),
                            some.column("vector").take(pa.array(rows)),
                        ],
                        ["width", "number", "bucket", "entry", "vector"],
                    )

    return df.select("entry", "vector").mapInArrow(
        run, "width int, number int, bucket int, entry long, vector array<double>"
    )


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All cosines of two sets of unit vectors, in double precision."""
    return queries @ rows.T


def best(asked: np.ndarray, entry: np.ndarray, scores: np.ndarray, most: int) -> list[tuple]:
    """Per query its ``most`` nearest entries, ties to the smaller one."""
    found = []
    for query, line in zip(asked.tolist(), scores):
        if line.size > most:
            least = np.partition(line, line.size - most)[line.size - most]
            at = np.flatnonzero(line >= least)
        else:
            at = np.arange(line.size)
        at = at[np.lexsort((entry[at], -line[at]))[:most]]
        found += [(query, e, s) for e, s in zip(entry[at].tolist(), line[at].tolist())]
    return found


def _met(most: int):
    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asking) and len(held):
            entry, units = held["entry"].to_numpy(), _units(np.stack(held["vector"].to_numpy()))
            for a in range(0, len(asking), BLOCK_QUERIES):
                some = asking.iloc[a : a + BLOCK_QUERIES]
                scores = cosines(_units(np.stack(some["vector"].to_numpy())), units)
                rows += best(some["entry"].to_numpy(), entry, scores, most)
        return pd.DataFrame(rows, columns=["asked", "entry", "score"])

    return run


_FOUND = "asked long, entry long, score double"


def probed_entries(asking: DataFrame, index: DataFrame, hashes: Hashes, most: int) -> DataFrame:
    """(asked, entry, score): the nearest entries found in each block that a query looks into."""
    held = written(_dealt(index, hashes, asking=False), "polytope-index")
    asked = written(_dealt(asking, hashes, asking=True), "polytope-probes")
    keys = ["width", "number", "bucket"]
    # one row per bucket, of which there are at most so many as the hashes name
    sizes = held.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    crowds = asked.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("crowds"))
    splits = written(sizes.join(crowds, keys), "polytope-splits")
    few = F.broadcast(splits)
    held = held.join(few, keys).select(
        *keys,
        F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"),
        "entry",
        "vector",
    )
    asked = asked.join(few, keys).select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("entry"), F.col("crowds")).cast("int").alias("crowd"),
        "entry",
        "vector",
    )
    keys = [*keys, "block", "crowd"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_met(most), _FOUND)


def scanned_entries(asking: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """The same from all entries of the query's width: the queries travel in blocks of bounded
    size, one pass over the index each."""
    context, found = asking.sparkSession.sparkContext, None
    blocks = -(-asking.count() // SCAN_QUERIES)
    dealt = asking.withColumn("b", F.pmod(F.xxhash64("entry"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        rows = dealt.where(F.col("b") == block).select("entry", "vector").collect()
        by_width: dict[int, list] = {}
        for row in rows:
            by_width.setdefault(len(row.vector), []).append(row)
        held = context.broadcast(
            {
                width: (np.array([r.entry for r in some]), _units(np.array([r.vector for r in some])))
                for width, some in by_width.items()
            }
        )

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                    rows = []
                    for at, units in _matrix(some.column("vector")):
                        if units.shape[1] in held.value:
                            asked, wanted = held.value[units.shape[1]]
                            entry = some.column("entry").to_numpy()[at]
                            rows += best(asked, entry, cosines(wanted, units), most)
                    columns = list(zip(*rows)) or [(), (), ()]
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                        ["asked", "entry", "score"],
                    )

        some = index.select("entry", "vector").mapInArrow(run, _FOUND)
        found = some if found is None else found.unionByName(some)
    return found


def nearest(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest of (asked, entry, score), every entry once."""
    once = found.groupBy("asked", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "entry")
    return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).drop("at")


def search(rows: DataFrame, queries: Column, k: int = NEIGHBOURS, **given) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of (vec_id, embedding) that ``queries``
    picks, the ``k`` rows of largest cosine found, nearest first, ties to the smaller id.

    Vectors that are null, zero or hold a null or non-finite component take no part, rows with a
    null id neither.  Vectors meet those of their own length only.  Rows that repeat an id with
    another vector are rows of their own, those that repeat both are one.  Fewer than ``k`` rows
    are returned only where there are no more; the queries whose buckets hold too few are compared
    with all.  An empty table gives no rows.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), "embedding")
    plain = plain.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    plain = plain.select("vec_id", "vector").distinct()
    most = k + 1  # the query itself may be among them
    index = written(entries(plain, most), "polytope-entries")
    size = index.agg(F.count("*"), F.max(F.size("vector"))).first()
    hashes = hashes_for(size[0], size[1] or 2, **given)
    # queries that share a vector ask once, under the entry of that vector
    own = plain.where(queries).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(COPIES)).cast("int"))
    asked = own.select("vector").distinct().join(index, "vector")
    copies = asked.select("vector", "entry").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    )
    own = own.join(copies, ["vector", "salt"]).select("vec_id", "entry")
    asked = written(asked.select("entry", "vector"), "polytope-queries")
    found = written(nearest(probed_entries(asked, index, hashes, most), most), "polytope-found")
    held = found.join(index.select("entry", "ids"), "entry").withColumn("n", F.size("ids"))
    short = held.groupBy("asked").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    short = asked.join(short.select(F.col("asked").alias("entry")), "entry", "left_anti")
    more = scanned_entries(short, index, most)
    if more is not None:
        more = more.join(index.select("entry", "ids"), "entry")
        held = held.join(short.select(F.col("entry").alias("asked")), "asked", "left_anti")
        held = held.drop("n").unionByName(more.select("entry", "asked", "score", "ids"))
    # at most k + 1 entries of at most k + 1 ids per vector that asks
    answers = held.groupBy("asked").agg(
        F.slice(
            F.array_sort(
                F.flatten(
                    F.collect_list(
                        F.transform(
                            "ids",
                            lambda i: F.struct(
                                (-F.col("score")).alias("far"), i.alias("vec_id"), F.col("entry").alias("entry")
                            ),
                        )
                    )
                )
            ),
            1,
            most,
        ).alias("answers")
    )
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    own = own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(COPIES)).cast("int"))
    joined = own.join(salted, (own["entry"] == salted["asked"]) & (own["salt"] == salted["salt"]))
    others = F.slice(F.filter("answers", lambda a: (a["vec_id"] != F.col("vec_id")) | (a["entry"] != F.col("asked"))), 1, k)
    each = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "found"))
    return each.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("found.vec_id").alias("vec_id"),
        (-F.col("found.far")).alias("score"),
    )


def op11_neighbours(spark, sf_dir: str) -> DataFrame:
    """``search`` of all embeddings for the rows whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0)
