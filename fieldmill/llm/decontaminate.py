"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces.  Whatever text matches the
item within k edits holds one piece unchanged, so exact piece hits (Aho-Corasick) find every
place worth a look; Myers' bit-parallel distance then decides it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import filtered, table, texts

#: Edits that still count as the item, as a share of its characters.
ERROR_RATE = 0.06
#: Characters of items that travel to the executors at once; more items take more passes.
BLOCK_CHARS = 4 << 20
#: Characters of a text that are searched at once; the cuts overlap by an item and its budget.
STRETCH = 1 << 22

_BLANKS = re.compile(r"\s+")


def normalized(text: str) -> str:
    """Lower case, every run of white space one space, none at the ends."""
    return _BLANKS.sub(" ", text.lower()).strip()


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces with their places, of lengths that differ by one at most."""
    n, parts = len(item), errors + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and the first place behind
    such a stretch: Myers' bit vectors, one step per character of the text."""
    m = len(item)
    where: dict[str, int] = {}
    for at, char in enumerate(item):
        where[char] = where.get(char, 0) | 1 << at
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best, end = m, 0
    for at, char in enumerate(text):
        eq = where.get(char, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise = down | (~(x | up) & ones)
        fall = up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1) & ones
        fall = (fall << 1) & ones
        v = eq | down
        up = fall | (~(v | rise) & ones)
        down = rise & v
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, item, budget(item, rate)) for i, item in items]
        self.reach = max((len(item) + errors for _, item, errors in self.items), default=0)
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item, errors) in enumerate(self.items):
            for at, piece in pieces(item, errors):
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, int]]:
        """Per matching item its id with (least distance, place behind the match)."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items:
            return found
        text = normalized(text)
        for begin in range(0, max(len(text), 1), STRETCH):
            part = text[begin : begin + STRETCH + 2 * self.reach]
            looked: set[tuple[int, int]] = set()
            for end, (size, owners) in self.automaton.iter(part):
                for number, at in owners:
                    item_id, item, errors = self.items[number]
                    # starts within errors + 1 places of each other share one look
                    start = (end + 1 - size - at) // (errors + 1) * (errors + 1)
                    if (number, start) in looked or found.get(item_id, (1,))[0] == 0:
                        continue
                    looked.add((number, start))
                    low = max(0, start - errors)
                    edits, behind = distance(item, part[low : start + len(item) + 2 * errors])
                    if edits <= errors and edits < found.get(item_id, (errors + 1,))[0]:
                        found[item_id] = edits, begin + low + behind
        return found


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in bounded blocks: each has about ``block_chars`` characters at most.

    Items without a letter or figure, null ones too, match nothing and are left out.  Rows that
    repeat an id are items of their own, reported under that id.
    """
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = int(max(1, -(-total // block_chars)))
    dealt = items.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("b"))
    for block in range(count):
        rows = dealt.where(F.col("b") == block).select("doc_id", "text").collect()
        found = ((row.doc_id, normalized(row.text)) for row in rows if row.doc_id is not None)
        yield sorted((i, item) for i, item in found if any(c.isalnum() for c in item))


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, edits, end) of rows (doc_id, text) that hold an item within its budget:
    one row per document and item with the least distance and where, in the normalized text,
    the first such match ends.

    ``items`` are rows (doc_id, text).  Every pass takes one block of items, whose size is
    bounded, over all documents.  No shuffle.
    """
    context = docs.sparkSession.sparkContext
    found = None
    for block in blocks(items):
        held = context.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*held.value)
            for batch in batches:
                pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                rows = [
                    (doc_id, item, edits, end)
                    for doc_id, text in pairs
                    for item, (edits, end) in sorted(matcher.hits(text).items())
                ]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.int64()) for column in columns],
                    ["doc_id", "item_id", "edits", "end"],
                )

        some = docs.select("doc_id", "text").mapInArrow(
            run, "doc_id long, item_id long, edits long, end long"
        )
        found = some if found is None else found.unionByName(some)
    return found


def test_items(spark, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "benchmark"), "item_id")


def judged(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Every row of (doc_id, text) with ``items``, the ids of the items that its own text holds, and
    ``edits``, the least distance (null for none).

    Each block of items is one pass that adds to what the passes before have found, so nothing is
    joined and no row depends on its id: rows with a null or a repeated id are judged like any
    other, null and empty texts hold nothing, an empty table gives no rows.  No shuffle.
    """
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.array().cast("array<long>").alias("items"),
        F.lit(None).cast("long").alias("edits"),
    )
    for block in blocks(items):
        held = docs.sparkSession.sparkContext.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*held.value)
            for batch in batches:
                hits = [matcher.hits(text or "") for text in batch.column("text").to_pylist()]
                before = zip(batch.column("items").to_pylist(), batch.column("edits").to_pylist())
                both = [
                    (
                        sorted({*known, *some}),
                        min([edits for edits, _ in some.values()] + ([] if least is None else [least]), default=None),
                    )
                    for some, (known, least) in zip(hits, before)
                ]
                ids, least = zip(*both) if both else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text"),
                        pa.array(ids, pa.list_(pa.int64())),
                        pa.array(least, pa.int64()),
                    ],
                    ["doc_id", "text", "items", "edits"],
                )

        found = found.mapInArrow(run, "doc_id long, text string, items array<long>, edits long")
    return found.drop("text")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, leaked, n_items, the ids of its items and the least distance.

    A row per row: null and repeated ids, null and empty texts as ``judged`` has them.
    """
    docs = texts(table(spark, sf_dir, "documents"))
    return judged(docs, test_items(spark, sf_dir)).select(
        "doc_id",
        (F.size("items") > 0).alias("leaked"),
        F.size("items").alias("n_items"),
        "items",
        "edits",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a test item, all columns kept; a stage's filter.

    Every row is judged by its own text; each block of items is one pass, without a shuffle.
    """
    for block in blocks(items):
        held = docs.sparkSession.sparkContext.broadcast((block, ERROR_RATE))

        def make(held=held):
            matcher = Matcher(*held.value)
            return lambda text: not matcher.hits(text)

        docs = filtered(docs, make)
    return docs
