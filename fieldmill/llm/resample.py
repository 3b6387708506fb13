"""Importance resampling towards a target distribution.

Hashed counts of word runs in the documents and in the target give every bucket a gain, the
logarithm of how much likelier the target uses it.  A document's weight is the sum of its
features' gains, taken from an array by bucket; a Gumbel number drawn from the id turns the
weights into a sample without replacement, which is simply the highest scores.  The cutoff is
found by bisection over the stored scores: each step is one job that counts rows exactly.  Only
the drawn rows are sorted, by range, for their ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import table, written
from fieldmill.operators.batching import dense_index

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
MIN_WORDS = 20
PERCENT = 5
#: Bytes of text that are taken at once; only a longer single text takes more.
STRETCH = 4 << 20
#: Parts that one counting job cuts the interval of a cutoff into.
PARTS = 64

_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
_MASKS = np.uint32(0xFF)


def _byte_table() -> np.ndarray:
    """What a byte of the crc's state turns into."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = (found >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (found & np.uint32(1)))
    return found


_TABLE = _byte_table()


def _appended(state: np.ndarray, byte: int | np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ byte) & _MASKS] ^ (state >> np.uint32(8))


def _squared(tables: np.ndarray) -> np.ndarray:
    """The tables of twice as many bytes of zeros."""
    return np.stack([_moved(tables[k], tables) for k in range(4)])


def _moved(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The crc with as many bytes of zeros behind it as the four tables stand for."""
    moved = tables[0][crc & _MASKS]
    for k in range(1, 4):
        moved = moved ^ tables[k][(crc >> np.uint32(8 * k)) & _MASKS]
    return moved


def _zero_tables() -> list[np.ndarray]:
    """Tables for 1, 2, 4, ... bytes of zeros, up to the longest text."""
    one = []
    for k in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one.append(_TABLE[value & _MASKS] ^ (value >> np.uint32(8)))
    found = [np.stack(one)]
    while len(found) < 32:
        found.append(_squared(found[-1]))
    return found


_ZEROS = _zero_tables()


def joined_crc(front: np.ndarray, back: np.ndarray, back_bytes: np.ndarray) -> np.ndarray:
    """The crc32 of two texts one behind the other, from their own."""
    moved, bit = front, 0
    most = int(back_bytes.max(initial=0))
    while most >> bit:
        moved = np.where((back_bytes >> bit) & 1, _moved(moved, _ZEROS[bit]), moved)
        bit += 1
    return moved ^ back


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32 of every word: one byte of all words at a time, longest words first."""
    found = np.zeros(starts.size, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    far = int(np.searchsorted(-sizes[order], -LONG_WORD, "left"))
    for word in order[:far].tolist():
        found[word] = zlib.crc32(data[starts[word] : starts[word] + sizes[word]])
    order = order[far:]
    at, left = starts[order], sizes[order]
    state = np.full(at.size, _ONES, np.uint32)
    for step in range(int(left[0]) if left.size else 0):
        count = int(np.searchsorted(-left, -step, "left"))  # words of more bytes than step
        state[:count] = _appended(state[:count], data[at[:count] + step])
    found[order] = state ^ _ONES
    return found


@dataclass(frozen=True)
class Features:
    """Features of some texts: their buckets, and per feature the number of its text."""

    buckets: np.ndarray
    owners: np.ndarray
    n_words: np.ndarray


def features(texts: list[bytes], buckets: int = BUCKETS) -> Features:
    """All runs of 1 to 3 words of each text: lower-cased ASCII letters, figures and every byte
    of a character beyond ASCII make words."""
    sizes = np.array([len(text) + 1 for text in texts], np.int64)
    data = _LOWERED[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = np.zeros(data.size + 1, np.int8)
    inside[1:] = _WORD_BYTE[data]  # every text has a blank behind it, so no word spans two
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    lengths = np.flatnonzero(edges == -1) - starts
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    crc = word_crcs(data, starts, lengths)
    found, owners, run = [crc], [owner], crc
    for more in range(1, RUN):
        # a run that ends at word i from the run that ended one word earlier
        run = _appended(run[:-1] ^ _ONES, np.uint32(0x20)) ^ _ONES
        run = joined_crc(run, crc[more:], lengths[more:])
        same = owner[more:] == owner[: owner.size - more]
        found.append(run[same])
        owners.append(owner[more:][same])
    n_words = np.bincount(owner, minlength=len(texts))
    return Features(np.concatenate(found) % np.uint32(buckets), np.concatenate(owners), n_words)


def _stretches(values: list[str | None]) -> Iterator[list[bytes]]:
    """Whole texts, about STRETCH bytes at a time; null is the empty text."""
    held: list[bytes] = []
    size = 0
    for value in values:
        data = (value or "").encode("utf-8", "replace")
        if held and size + len(data) > STRETCH:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    A task adds up its own rows first, so at most one row per bucket and task is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in _stretches(batch.column(0).to_pylist()):
                total += np.bincount(features(some, buckets).buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"]
        )

    found = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithmic ratio per bucket, each bucket counted once more."""
    size = len(source)
    n_source, n_target = int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(
                1000
                * math.log(
                    float(t + 1) * float(n_source + size) / (float(s + 1) * float(n_target + size))
                )
            )
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id: int | None) -> int:
    """Thousandths of a Gumbel number drawn from the id; a null id counts as the empty text."""
    shown = "" if doc_id is None else doc_id
    drawn = int(hashlib.sha256(f"42:{shown}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"


def scored(docs: DataFrame, gain: np.ndarray, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) per row of (doc_id, text), no shuffle.
    ``gain`` has one number per bucket, whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for some in _stretches(batch.column("text").to_pylist()):
                found = features(some, gain.size)
                sums = np.zeros(len(some), np.int64)
                np.add.at(sums, found.owners, gain[found.buckets])
                own = ids[at : at + len(some)]
                at += len(some)
                drawn = np.array([noise(i) for i in own], np.int64)
                columns = [
                    pa.array(own, pa.int64()),
                    pa.array(np.bincount(found.owners, minlength=len(some)), pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(sums + drawn, pa.int64()),
                    pa.array(found.n_words >= min_words, pa.bool_()),
                ]
                names = ["doc_id", "n_features", "weight", "score", "eligible"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, _SCORED)


def smallest(rows: DataFrame, key: str, count: int) -> tuple[int, int]:
    """The ``count``-th smallest value of a whole-number column without nulls, and how many rows
    lie below it: every job counts the rows in PARTS equal parts of the interval left."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // PARTS)
        # wide numbers, as ids may lie further apart than a long reaches
        part = F.expr(
            f"(cast(`{key}` AS decimal(20, 0)) - cast('{low}' AS decimal(20, 0)))"
            f" div cast('{width}' AS decimal(20, 0))"
        )
        held = rows.where(F.col(key).between(low, high)).groupBy(part.alias("part")).count().collect()
        for row in sorted(held, key=lambda row: row.part):
            if below + row["count"] >= count:
                low, high = low + row.part * width, min(high, low + (row.part + 1) * width - 1)
                break
            below += row["count"]
    return low, below


#: In the order of the draw: highest scores, then smaller ids (null ids last), then what still
#: differs; rows alike in all of these are told apart by their place in the stored table.
_KEYS = ("k_score", "k_null", "k_id", "k_features", "row")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "k_score": -F.col("score"),
            "k_null": F.col("doc_id").isNull().cast("long"),
            "k_id": F.coalesce("doc_id", F.lit(0)).cast("long"),
            "k_features": F.col("n_features"),
        }
    )


def cutoff(rows: DataFrame, count: int) -> Column:
    """Which rows are the first ``count`` by _KEYS.

    The bisection finds the cutoff of the score; only rows that tie there are looked at for the
    next key, and so on, so ties of any number are cut exactly.
    """
    chosen, tied = F.lit(False), F.lit(True)
    for key in _KEYS:
        value, below = smallest(rows.where(tied), key, count)
        chosen = chosen | (tied & (F.col(key) < F.lit(value)))
        tied = tied & (F.col(key) == F.lit(value))
        count -= below
        if rows.where(tied).count() == count:
            break
    return chosen | tied


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs`` (doc_id, text).

    Of the N rows with at least 20 words ``percent`` in a hundred, rounded down, are drawn;
    the rank of the others is null.  ``target`` has a column text.  Null and empty texts have no
    feature and weight 0.  Rows that share an id share its random number and are drawn as rows of
    their own.  Empty tables count nothing.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    stored = scored(docs, gain).withColumn("row", F.monotonically_increasing_id())
    stored = _keyed(written(stored, "resample-scores"))
    count = stored.where("eligible").count() * percent // 100
    plain = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if count == 0:
        return stored.select(*plain, no_rank)
    drawn = F.col("eligible") & cutoff(stored.where("eligible"), count)
    ranks = dense_index(stored.where(drawn).select(*plain, *_KEYS), *_KEYS, name="rank")
    return ranks.select(*plain, (F.col("rank") + 1).alias("rank")).unionByName(
        stored.where(~drawn).select(*plain, no_rank)
    )


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """``resampled`` of all documents, with all benchmark texts as the target."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
