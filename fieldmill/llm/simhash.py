"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has, for each of 64 bits, the majority of its shingles' hashes.  Bit
``i`` is given a non-zero vector of radius + 1 bits; the mask of a non-zero vector ``v``
keeps the bits whose vector has an odd product with ``v``.  Any ``radius`` differing bits
span too little to exclude every ``v``, so two fingerprints within the radius agree under
some mask: all such pairs meet in a table, without exception.  Only distinct fingerprints
are linked; copies follow their fingerprint.

The pipeline's stage calls the same operator with the same shingles and radius.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import keeping, release, stretches, table, texts, written

BITS = 64
SHINGLE = 3
RADIUS = 3
#: A table's bucket with more fingerprints is dealt out once more by its remaining bits.
HOT = 4096
#: A larger bucket looks up the neighbours of each fingerprint instead of comparing pairs.
PAIRWISE = 8192


def fingerprint(text: str, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """The majority bits of the XXH64 (seed 42) of all word shingles, repeats included.

    A to Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  Fewer words than a shingle
    hash as one; no word gives 0.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, starts.size, block):
        spans = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist())
        hashes = np.array([one(data[a:b], 42) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > starts.size, bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of (doc_id, text), the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            found = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["doc_id", "fp"],
            )
        release()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, bits: list[int]) -> list[int]:
    """The 2**(radius+1) - 1 masks over the given bit places, as unsigned integers."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for at, bit in enumerate(bits) if ((at % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _root(parent: np.ndarray, at: int) -> int:
    while parent[at] != at:
        parent[at] = parent[parent[at]]
        at = parent[at]
    return at


def _neighbours(fps: np.ndarray, free: list[int], radius: int) -> Iterator[tuple]:
    """Pairs (i, j) within the radius by looking up every variant in the ``free`` bits."""
    for size in range(1, radius + 1):
        for places in combinations(free, size):
            flip = np.uint64(sum(1 << place for place in places))
            wanted = fps ^ flip
            at = np.minimum(np.searchsorted(fps, wanted), fps.size - 1)
            here = np.flatnonzero((fps[at] == wanted) & (fps < wanted))
            yield here, at[here]


def forest(fps: np.ndarray, radius: int, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what all pairs within the radius connect, without a cycle.

    ``fps`` are the distinct fingerprints of a bucket, which agree outside the ``free`` bits.
    A bucket yields fewer links than it has fingerprints, never its pairs.
    """
    fps = np.sort(fps)
    parent = np.arange(fps.size)
    left, right = [], []

    def join(some: np.ndarray, others: np.ndarray) -> None:
        for i, j in zip(some.tolist(), others.tolist()):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)

    if fps.size <= PAIRWISE:
        for i in range(fps.size - 1):
            near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
            join(np.full(near.size, i), near)
    else:
        for some, others in _neighbours(fps, free, radius):
            join(some, others)
    return fps[np.array(left, int)], fps[np.array(right, int)]


def _linked(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) links out of rows (mask, key, fp): one group is one bucket of one table."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        free = [b for b in range(BITS) if not int(group["mask"].iloc[0]) >> b & 1]
        fps = np.unique(group["fp"].to_numpy(np.int64).view(np.uint64))
        a, b = forest(fps, radius, free)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.groupBy("mask", "key").applyInPandas(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``fp``), a connecting subset of all
    pairs within ``radius`` bits.

    A bucket with one fingerprint is dropped before anything is grouped.  A bucket with more
    than HOT is dealt out by masks over the bits its own mask left out, with the same
    guarantee, so no task holds a hot bucket whole.
    """
    spark = fps.sparkSession
    rows = ",".join(str(_signed(mask)) for mask in masks(radius, list(range(BITS))))
    tables = F.from_json(F.lit(f"[{rows}]"), "array<bigint>")
    keyed = fps.select("fp", F.explode(tables).alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "simhash-buckets")
    hot = sizes.where(F.col("n") > HOT)
    shared = keyed.join(sizes.where(F.col("n") <= HOT), ["mask", "key"]).select("mask", "key", "fp")
    first = masks(radius, list(range(BITS)))
    second = [
        {"mask": _signed(mask), "finer": _signed(mask | more)}
        for mask in first
        for more in masks(radius, [b for b in range(BITS) if not mask >> b & 1])
    ]
    pairs = F.from_json(F.lit(json.dumps(second)), "array<struct<mask:bigint,finer:bigint>>")
    deeper = spark.range(1).select(F.inline(pairs))
    dealt = (
        keyed.join(hot, ["mask", "key"])
        .join(F.broadcast(deeper), "mask")  # 15 x 15 rows, whatever the input
        .select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")
    )
    # little data but much work: as many tasks as the session shuffles into, whatever its bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _linked(shared.unionByName(dealt).repartition(tasks, "mask", "key"), radius)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that links (a, b) lead to, by alternating stars.

    Every round links larger neighbours, then smaller ones, to the least neighbour, and is a
    table in the shared folder.  Only nodes with a link appear.  Raises if it fails to settle.
    """
    pairs = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "simhash-links",
    )
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        stars = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        following = written(stars.distinct(), "simhash-links")
        settled = following.join(pairs, ["u", "v"], "left_anti").limit(1).count() == 0 and (
            pairs.join(following, ["u", "v"], "left_anti").limit(1).count() == 0
        )
        pairs = following
        if settled:
            tops = pairs.select(F.col("v").alias("node")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                tops.select("node", F.col("node").alias("component"))
            )
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, text): the least doc_id reachable over links of
    fingerprints that differ in at most ``radius`` bits, the own id included.

    Null ids keep their row and, when nothing else is reachable, a null component.
    """
    found = written(fingerprints(docs, shingle), "simhash-fingerprints")
    classes = written(
        found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes"
    )
    member = components(links(classes.select("fp"), radius))
    named = classes.join(member, classes.fp == member.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return found.join(ids, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = grouped(texts(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The row of each component (``grouped``) with the least doc_id, all columns kept; a stage's
    filter.

    Rows that repeat the id stay together; rows with a null id stay as they are.
    """
    found = grouped(texts(docs), shingle, radius)
    return keeping(docs, found.where("doc_id <> component_id").select("doc_id"))
