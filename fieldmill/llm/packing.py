"""Packing by cutting-stock column generation.

Pieces of documents are the demand, sequences the stock.  A linear program over the histogram
of piece lengths chooses among patterns (how many pieces of which lengths share a sequence);
a knapsack program prices new patterns until none pays.  Rounded patterns are then assigned to
the ranked pieces of each length.  The histogram has at most ``CAPACITY / GRAIN`` rows, so the driver's
part does not grow with the documents.  Lengths are planned in coarse steps, rounded up, and
the places in a sequence follow from the exact ones.
"""

from __future__ import annotations

import re
import threading
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import chunks, release, stretches, table, texts, written

CAPACITY = 2048
#: Closes every document.
END = 1
#: The linear program stops this close to its bound, or after so many columns.
GAP = 1e-3
MOST_COLUMNS = 3000
#: Lengths are planned in steps of so many ids; the offsets are exact again.
GRAIN = 8
#: Pieces of a length and bucket that are ranked together, on average.
RANKED = 4096

#: Words that a worker remembers.
_CACHE = 900_000
_MARK = re.compile(r"(?<=[a-z])[,.](?= )")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    No token of the vocabulary spans white space, so the words between blanks are encoded one
    by one, and frequent words only once.  Many words go into one call, whose tokens are dealt to
    the words again.  ASCII words are encoded in lower case and without the comma
    or full stop behind a letter, which is a token of its own.  What is remembered is bounded: when
    it is full, only the words at hand stay.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.marks = {mark: self._alone([mark])[0] for mark in ",."} | {"": b""}

    def _alone(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(encoding.ids, "<u4").tobytes() for encoding in found]

    def _dealt(self, words: list[str]) -> list[bytes]:
        """The ids of words that one call encodes, told apart by where their tokens start."""
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        data = np.array(encoding.ids, "<u4").tobytes()
        starts = np.array(encoding.offsets, np.int64).reshape(-1, 2)[:, 0]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cuts = (4 * np.searchsorted(starts, np.cumsum(sizes) - sizes)).tolist()
        return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words without a combining mark, which could join the blank before it.

        Words of letters close with one token each, mostly: where a call has as many closing
        tokens as words, they tell the words apart.
        """
        calls = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        joined = self.tokenizer.encode_batch_fast(list(map(" ".join, calls)), add_special_tokens=False)
        found = []
        for some, encoding in zip(calls, joined):
            ids = np.array(encoding.ids, "<u4")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                found += self._dealt(some)
                continue
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip([0, *ends], ends)]
        return found

    def _learn_ascii(self, words: list[str]) -> None:
        lowered = " ".join(words).lower() + " "
        cores = _MARK.sub("", lowered).split(" ")
        cores.pop()  # behind the last blank
        known = self.cores  # taking its keys off a set would walk all of them
        new = [core for core in set(cores) if core not in known]
        letters = [core for core in new if core.isalpha()]
        self.cores.update(zip(letters, self._together(letters)))
        for at in range(0, len(others := [core for core in new if not core.isalpha()]), 1000):
            self.cores.update(zip(others[at : at + 1000], self._dealt(others[at : at + 1000])))
        marks = [word[len(core) :] for word, core in zip(words, cores)]
        self.known.update(
            (word, self.cores[core] + self.marks[mark]) for word, core, mark in zip(words, cores, marks)
        )

    def learn(self, words: set[str]) -> None:
        if len(self.known) > _CACHE:
            self.known = {word: self.known[word] for word in words if word in self.known}
        if len(self.cores) > _CACHE:
            self.cores.clear()
        known = self.known
        new = [word for word in words if word not in known]
        plain = [word for word in new if word.isascii()]
        if plain:
            self._learn_ascii(plain)
        others = [word for word in new if not word.isascii()]
        letters = [word for word in others if word.isalpha()]
        self.known.update(zip(letters, self._together(letters)))
        others = [word for word in others if not word.isalpha()]
        for at in range(0, len(others), 10_000):
            some = others[at : at + 10_000]
            self.known.update(zip(some, self._alone(some)))

    def encode(self, texts: list[str], stretch: int = 1 << 20) -> list[bytes]:
        """The ids of each text and END; long texts are worked off in stretches."""
        ends = np.array([END], "<u4").tobytes()
        if len(texts) > 1 and sum(map(len, texts)) <= 4 * stretch:
            split = [_words(text) for text in texts]
            self.learn(set().union(*split))
            return [b"".join(map(self.known.__getitem__, words)) + ends for words in split]
        found = []
        for text in texts:
            out, at = [], 0
            while at < len(text):
                cut = text.find(" ", at + stretch) if len(text) - at > stretch else -1
                part, at = (text[at:], len(text)) if cut < 0 else (text[at:cut], cut + 1)
                words = _words(part)
                self.learn(set(words))
                out.append(b"".join(map(self.known.__getitem__, words)))
            found.append(b"".join([*out, ends]))
        return found


def _words(text: str) -> list[str]:
    """Parts of a text between white space; the four separators that only Python takes for white
    space are left to the tokenizer."""
    if any(mark in text for mark in "\x1c\x1d\x1e\x1f"):
        return text.replace("\n", " ").split(" ")
    return text.split()


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder per worker, so that tasks share the words it knows."""
    return Encoder(path)


#: Seconds after which a worker that no longer encodes forgets its words.
_IDLE = 8.0
_forgetting: list[threading.Timer] = []


def _forget() -> None:
    _encoder.cache_clear()
    release()


def _forget_later(seconds: float | None) -> None:
    """Sets the time to forget, or with None puts it off: a worker may live on for other stages."""
    while _forgetting:
        _forgetting.pop().cancel()
    if seconds is not None:
        timer = threading.Timer(seconds, _forget)
        timer.daemon = True
        timer.start()
        _forgetting.append(timer)


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of rows (doc_id, text).

    A document is its ids and END; what exceeds ``capacity`` is cut off in full sequences, the
    rest is one more piece.  An empty text is END alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_later(None)
        encoder = _encoder(path)
        for batch in stretches(batches):
            rows = []
            ids, values = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for some, part in chunks(ids, values, 1 << 20):
                for doc_id, data in zip(some, encoder.encode(part)):
                    for at in range(0, len(data), 4 * capacity):
                        cut = data[at : at + 4 * capacity]
                        row = (doc_id, at // 4, len(cut) // 4, zlib.crc32(cut), len(data) // 4)
                        rows.append((*row, np.frombuffer(cut, "<u4").tolist()) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            kinds = [pa.int64()] * 5
            if with_ids:
                names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)], names
            )
        _forget_later(_IDLE)

    sql = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInArrow(run, sql + ", ids array<int>" * with_ids)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[dict, float]:
    """The pattern of the highest price, by an unbounded knapsack program: ``value[w]`` is the
    most that sizes adding up to at most ``w`` are worth."""
    value = np.zeros(room + 1)
    chosen = np.full(room + 1, -1)
    for total in range(int(sizes[0]), room + 1):
        n = np.searchsorted(sizes, total, side="right")
        worth = value[total - sizes[:n]] + prices[:n]
        at = int(np.argmax(worth))
        value[total], chosen[total] = worth[at], at
    total, pattern = room, {}
    while total >= sizes[0] and chosen[total] >= 0:
        at = int(chosen[total])
        pattern[at] = pattern.get(at, 0) + 1
        total -= int(sizes[at])
    return pattern, float(value[room])


def linear_program(
    sizes: np.ndarray, demand: np.ndarray, room: int, most_columns: int = MOST_COLUMNS
) -> list[tuple[dict[int, int], float]]:
    """Patterns (index of size -> copies) and how often to use each, by revised simplex with
    generated columns.  The first basis repeats one size per sequence."""
    fits = room // sizes
    basis = [{i: int(n)} for i, n in enumerate(fits)]
    inverse = np.diag(1 / fits)
    amounts = demand / fits
    for _ in range(most_columns):
        prices = inverse.sum(axis=0)
        pattern, worth = best_pattern(sizes, prices, room)
        spent = float(amounts.sum())
        # prices divided by the best pattern's are feasible for the dual: a lower bound
        if worth <= 1 + 1e-9 or spent - float(prices @ demand) / worth <= GAP * spent:
            break
        column = np.zeros(sizes.size)
        column[list(pattern)] = list(pattern.values())
        steps = inverse @ column
        able = np.flatnonzero(steps > 1e-9)
        out = int(able[np.argmin(amounts[able] / steps[able])])
        share = amounts[out] / steps[out]
        amounts -= share * steps
        amounts[out] = share
        np.maximum(amounts, 0, out=amounts)
        pivot = inverse[out] / steps[out]
        inverse -= np.outer(steps, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return list(zip(basis, amounts.tolist()))


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: copies}): patterns that together hold every piece exactly once.

    The program's amounts are rounded down, then each pattern is used once more while the
    pieces left allow it, largest fraction first; the rest is packed best fit, largest first.
    That rest has at most one sequence per size, however many documents there are.
    """
    sizes = np.array(sorted(n for n in histogram if histogram[n] > 0), np.int64)
    if not sizes.size:
        return []
    left = np.array([histogram[n] for n in sizes.tolist()], np.int64)
    found = linear_program(sizes, left.astype(float), room)
    result: list[tuple[int, dict[int, int]]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(int(left[i]) // n for i, n in pattern.items())])
        if times > 0:
            for i, n in pattern.items():
                left[i] -= times * n
            result.append((times, {int(sizes[i]): n for i, n in pattern.items()}))

    for pattern, amount in found:
        use(pattern, int(amount + 1e-9))
    full = [p for p in found if sum(int(sizes[i]) * n for i, n in p[0].items()) == room]
    for pattern, _ in sorted(full, key=lambda x: (-(x[1] % 1), sorted(x[0].items()))):
        use(pattern, 1)
    return result + best_fit({int(n): int(c) for n, c in zip(sizes, left) if c}, room)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Packs few pieces: each, longest first, into the sequence with the least room that fits."""
    room: dict[int, list[dict[int, int]]] = {}
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in room if r >= length), default=None)
            pattern = room[fit].pop() if fit is not None else {}
            if fit is not None and not room[fit]:
                del room[fit]
            pattern[length] = pattern.get(length, 0) + 1
            rest = (capacity if fit is None else fit) - length
            room.setdefault(rest, []).append(pattern)
    return [(1, pattern) for rest in sorted(room) for pattern in room[rest]]


def _slots(spark, patterns: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """Per pattern and size: ranks [low, high) of that size, copies in a sequence, and the
    pattern's first sequence."""
    rows, used, sequence = [], {}, 0
    for times, pattern in patterns:
        for size, copies in pattern.items():
            low = used.get(size, 0)
            used[size] = low + times * copies
            rows.append((size, low, used[size], copies, sequence))
        sequence += times
    return spark.createDataFrame(rows, "size long, low long, high long, copies long, first long")


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each size, without gathering a size in one task.

    Pieces are counted per size and bucket, the counts add up to each bucket's first rank, and
    only a bucket is sorted.  The number of buckets follows the number of pieces.
    """
    buckets = max(1, -(-found.count() // RANKED))
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    dealt = found.withColumn("bucket", spread)
    counts = dealt.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(bases, ["size", "bucket"]).select(
        *found.columns, (F.col("base") + F.col("at")).alias("rank")
    )


def pack(found: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows (doc_id, start, length, ids_crc32, doc_tokens).

    ``found`` is read several times: give a table.  Repeated rows are pieces of their own.  The
    slots that are broadcast follow from at most ``capacity / grain`` sizes.
    """
    names = found.columns
    sized = found.withColumn("size", F.expr(f"(length + {grain - 1}) div {grain}"))
    counts = sized.groupBy("size").agg(F.count("*").alias("n")).collect()
    patterns = plan({row["size"]: row.n for row in counts}, capacity // grain)
    if not patterns:
        none = F.lit(None).cast("long")
        return found.select("*", none.alias("sequence_id"), none.alias("offset"))
    slots = F.broadcast(_slots(found.sparkSession, patterns))
    held = ranked(sized).join(slots, "size").where("rank >= low AND rank < high")
    placed = held.withColumn("sequence_id", F.expr("first + (rank - low) div copies"))
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("size"), "rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return placed.select(*names, "sequence_id", offset.alias("offset"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of rows (doc_id, text) with their sequence and offset."""
    return pack(written(pieces(docs, path or tokenizer_path(), capacity), "packing-pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    return packed(texts(table(spark, sf_dir, "documents")))
