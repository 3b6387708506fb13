"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary choices; for the byte's choices so far, every context of the last 0 to
DEPTH bytes has a node that counts zeros and ones.  A node's weighted probability is half its
Krichevsky-Trofimov estimate and half the product over the contexts one byte longer, so all
depths are mixed by how well they explain the training texts.  Given the counts, a choice has
the mixed probability of the nodes on its path; a node that training never saw predicts as the
node above it.

The model is the table of all grams (DEPTH bytes and the next) with their probability.  Counts
are summed in Spark by the two latest bytes of the context, below which a tree is complete; the
tops of the trees, whose number is bounded by the alphabet, meet on the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import chunks, share_of, table, texts, written

DEPTH = 5
#: Follows every text; no UTF-8 text holds this byte.
END = 0xFF
#: Grams that travel to the executors at once; a larger model takes more passes.
BLOCK = 6_000_000
#: A word with at least this share of all tokens is frequent: at most 1 / FREQUENT such exist.
FREQUENT = 1e-6
#: Grams and words that a task counts before it sends them on.
HELD = 3_000_000

_LN10 = float(np.log(10))


def grams(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """A code per byte of ``data``: its context, the latest byte first, and the byte itself."""
    codes = np.frombuffer(bytes(depth) + data, np.uint8).astype(np.uint64)
    n = len(data)
    found = codes[depth:].copy()
    for back in range(1, depth + 1):
        found |= codes[depth - back : depth - back + n] << np.uint64(8 * (depth - back + 1))
    return found


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def coded(words: list[bytes]) -> bytes:
    """What is scored: the words with one blank between them, and END."""
    return b" ".join(words) + bytes([END])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not keys.size:
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begins], np.add.reduceat(counts[order], begins)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for step in range(7):
        shift += np.log(x + step)
    y = x + 7
    tail = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    total = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0)
    return total - np.log(np.pi)


def _half_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) - np.log(2)


@dataclass
class Nodes:
    """The nodes of one depth for one of a byte's eight choices, in order of their keys."""

    key: np.ndarray  # context, then the choices so far behind a leading one
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray | None = None

    @property
    def seen(self) -> np.ndarray:
        return self.zeros + self.ones > 0

    def kt(self) -> np.ndarray:
        return log_kt(self.zeros, self.ones)

    def close(self, below: Nodes | None) -> None:
        """Mixes in the nodes one byte deeper; without any this is the deepest."""
        own = self.kt()
        if below is None:
            self.weighted = own
            return
        parent = (below.key >> np.uint64(16) << np.uint64(8)) | (below.key & np.uint64(255))
        product = np.bincount(
            np.searchsorted(self.key, parent), below.weighted, minlength=self.key.size
        )
        self.weighted = _half_sum(own, product)

    def stop(self) -> np.ndarray:
        """The share of a node's own estimate in its mixture."""
        return np.exp(np.minimum(self.kt() - np.log(2) - self.weighted, 0))


def nodes_of(context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, level: int) -> tuple[Nodes, np.ndarray]:
    """Nodes of one choice out of rows in order of (context, symbol), and each row's node."""
    prefix = (np.uint64(1) << np.uint64(level)) | (symbol >> np.uint64(8 - level))
    key = (context << np.uint64(8)) | prefix
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    bit = (symbol >> np.uint64(7 - level)) & np.uint64(1)
    ones = np.add.reduceat(np.where(bit == 1, counts, 0.0), begins)
    zeros = np.add.reduceat(np.where(bit == 0, counts, 0.0), begins)
    where = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    return Nodes(key[begins], zeros, ones), where


class Levels:
    """Rows (context of ``depth`` bytes, symbol) of one depth, and the way to them from grams."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, full: int):
        key = (codes >> np.uint64(8 * (full - depth + 1)) << np.uint64(8)) | (codes & np.uint64(255))
        self.key, self.row = np.unique(key, return_inverse=True)
        self.counts = np.bincount(self.row, counts, minlength=self.key.size)

    def nodes(self, level: int) -> tuple[Nodes, np.ndarray, np.ndarray]:
        symbol = self.key & np.uint64(255)
        found, where = nodes_of(self.key >> np.uint64(8), symbol, self.counts, level)
        bit = ((symbol >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
        return found, where[self.row], bit[self.row]


def chances(
    codes: np.ndarray, counts: np.ndarray, full: int, least: int
) -> Iterator[tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]]:
    """Per choice: the nodes of depth ``least``, each gram's node among them and bit, and the
    probability of that bit given by the tree from that depth on.

    ``codes`` are distinct; grams with count 0 are asked about but teach nothing.
    """
    depths = [Levels(codes, counts, depth, full) for depth in range(least, full + 1)]
    for level in range(8):
        chain = [depth.nodes(level) for depth in depths]
        below = None
        for nodes, _, _ in reversed(chain):
            nodes.close(below)
            below = nodes
        chance = None
        for nodes, where, bit in reversed(chain):
            own = _chance(nodes, where, bit)
            if chance is not None:
                stop = nodes.stop()[where]
                own = np.where(deeper_seen, stop * own + (1 - stop) * chance, own)  # noqa: F821
            chance, deeper_seen = own, nodes.seen[where]
        nodes, where, bit = chain[0]
        yield nodes, where, bit, chance


def _chance(nodes: Nodes, where: np.ndarray, bit: np.ndarray) -> np.ndarray:
    total = nodes.zeros + nodes.ones + 1
    picked = np.where(bit == 1, nodes.ones[where], nodes.zeros[where])
    return (picked + 0.5) / total[where]


SPLIT = 2
"""Bytes of context by which trees are dealt out."""


def _tops(codes: np.ndarray, counts: np.ndarray, full: int) -> pd.DataFrame:
    """The nodes at depth SPLIT of the trees in a bucket: key, zeros, ones, weighted."""
    parts = [nodes for nodes, _, _, _ in chances(codes, counts, full, SPLIT)]
    seen = [nodes.seen for nodes in parts]
    return pd.DataFrame(
        {
            "key": np.concatenate([n.key[s] for n, s in zip(parts, seen)]).view(np.int64),
            "zeros": np.concatenate([n.zeros[s] for n, s in zip(parts, seen)]),
            "ones": np.concatenate([n.ones[s] for n, s in zip(parts, seen)]),
            "weighted": np.concatenate([n.weighted[s] for n, s in zip(parts, seen)]),
        }
    )


@dataclass
class Top:
    """The seen nodes above SPLIT, from depth 0 on: key, own chance of a one, share of it."""

    depths: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(tops: pd.DataFrame) -> Top:
        tops = tops.sort_values("key")
        deeper = Nodes(
            tops["key"].to_numpy(np.int64).view(np.uint64),
            tops["zeros"].to_numpy(float),
            tops["ones"].to_numpy(float),
            tops["weighted"].to_numpy(float),
        )
        found = []
        for _ in range(SPLIT):
            parent = _above(deeper.key, 1)
            own, where = np.unique(parent, return_inverse=True)
            nodes = Nodes(
                own,
                np.bincount(where, deeper.zeros, minlength=own.size),
                np.bincount(where, deeper.ones, minlength=own.size),
            )
            nodes.close(deeper)
            one = (nodes.ones + 0.5) / (nodes.zeros + nodes.ones + 1)
            found.append((own, one, nodes.stop()))
            deeper = nodes
        return Top(found[::-1])

    def mix(self, key: np.ndarray, seen: np.ndarray, where: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Chance of a one at the root, from ``one`` at the nodes ``key[where]`` of depth SPLIT."""
        reached = seen[where]
        for depth in range(SPLIT - 1, -1, -1):
            keys, own, stop = self.depths[depth]
            up = _above(key, SPLIT - depth)
            at = np.minimum(np.searchsorted(keys, up), max(keys.size - 1, 0))
            here = keys[at] == up if keys.size else np.zeros(up.size, bool)
            mine = np.where(here, own[at] if keys.size else 0.5, 0.5)[where]
            share = np.where(here, stop[at] if keys.size else 1.0, 1.0)[where]
            one = np.where(reached, share * mine + (1 - share) * one, mine)
            reached = here[where]
        return one


def _above(key: np.ndarray, steps: int) -> np.ndarray:
    """Keys of the nodes whose contexts are ``steps`` bytes shorter, for the same choices."""
    return (key >> np.uint64(8 * steps + 8) << np.uint64(8)) | (key & np.uint64(255))


def log_chances(codes: np.ndarray, counts: np.ndarray, full: int, top: Top) -> np.ndarray:
    """Natural logarithm of the probability of each gram's byte given its context."""
    total = np.zeros(codes.size)
    for nodes, where, bit, chance in chances(codes, counts, full, SPLIT):
        one = top.mix(nodes.key, nodes.seen, where, np.where(bit == 1, chance, 1 - chance))
        total += np.log(np.where(bit == 1, one, 1 - one))
    return total


def _blob(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1) if values.dtype.itemsize < 8 else values.tobytes()


_PAIRS = "bucket long, keys binary, counts binary"


def _emit(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, keys, counts), one per bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    runs = np.split(order, cuts) if order.size else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[run[0]]) for run in runs], pa.int64()),
            pa.array([keys[run].tobytes() for run in runs], pa.binary()),
            pa.array([_blob(counts[run].astype("<u4")) for run in runs], pa.binary()),
        ],
        ["bucket", "keys", "counts"],
    )


def _gathered(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(group["keys"]), "<u8")
    counts = np.frombuffer(b"".join(zlib.decompress(c) for c in group["counts"]), "<u4")
    return summed(keys, counts.astype(np.float64))


def counted(rows: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """(bucket, keys, counts): every gram of rows (text, learn), with how often rows to learn
    from have it; grams of the other rows alone count 0.  One row per bucket, a written table.

    A bucket holds whole trees: its number follows from the two latest bytes of the context.
    Tasks sum their grams before sending them, so what arrives are distinct grams per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0)

        def sent() -> pa.RecordBatch:
            tree = keys >> np.uint64(8 * (depth - SPLIT + 1))
            dealt = (tree * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            return _emit(keys, counts, (dealt % np.uint64(buckets)).astype(np.int64))

        for batch in batches:
            learn, values = batch.column("learn").to_pylist(), batch.column("text").to_pylist()
            for some, part in chunks(learn, values, 2 << 20):
                data = [grams(coded(words_of(text)), depth) for text in part]
                weight = np.repeat(np.array(some, float), [codes.size for codes in data])
                fresh = summed(np.concatenate(data), weight)
                keys, counts = summed(
                    np.concatenate((keys, fresh[0])), np.concatenate((counts, fresh[1]))
                )
                if keys.size > HELD:
                    yield sent()
                    keys, counts = keys[:0], counts[:0]
        yield sent()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _gathered(group)
        row = (int(group["bucket"].iloc[0]), keys.tobytes(), counts.tobytes())
        return pd.DataFrame([row], columns=["bucket", "keys", "counts"])

    sent = rows.select("text", "learn").mapInArrow(run, _PAIRS)
    return written(sent.groupBy("bucket").applyInPandas(merged, _PAIRS), "context-counts")


def _each(counts: DataFrame, use, sql: str) -> DataFrame:
    """``use(keys, counts)`` per bucket of ``counted``; an empty bucket has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, n in zip(batch["keys"], batch["counts"]):
                codes = np.frombuffer(keys, "<u8")
                if codes.size:
                    yield use(codes, np.frombuffer(n, "<f8"))

    return counts.mapInPandas(run, sql)


def model(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(n, keys, logs): the grams with the logarithm of their probability, in rows of a bucket.

    The driver holds the nodes of depth SPLIT only: at most 255 for each of 256**SPLIT contexts.
    """
    tops = _each(
        counts,
        lambda codes, n: _tops(codes, n, depth),
        "key long, zeros double, ones double, weighted double",
    ).toPandas()
    top = counts.sparkSession.sparkContext.broadcast(Top.of(tops))

    def finish(codes: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        logs = log_chances(codes, n, depth, top.value) / _LN10
        return pd.DataFrame({"n": [codes.size], "keys": [codes.tobytes()], "logs": [logs.tobytes()]})

    return written(_each(counts, finish, "n long, keys binary, logs binary"), "context-model")


class Lookup:
    """Values of 64-bit keys by open addressing in arrays; 0 for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(keys.size * 3 // 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, values.dtype)
        taken = np.zeros(1 << bits, bool)
        waiting = np.arange(keys.size)
        slot = self._slot(keys)
        while waiting.size:
            free = waiting[~taken[slot[waiting]]]
            self.keys[slot[free]] = keys[free]  # of several the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            taken[slot[won]] = True
            waiting = waiting[(self.keys[slot[waiting]] != keys[waiting]) | ~taken[slot[waiting]]]
            slot[waiting] = (slot[waiting] + 1) & self.mask
        self.taken = taken

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        same = self.keys[slot] == keys
        found = np.where(same & self.taken[slot], self.values[slot], self.values.dtype.type(0))
        waiting = np.flatnonzero(~same & self.taken[slot])
        while waiting.size:
            slot[waiting] = (slot[waiting] + 1) & self.mask
            at = slot[waiting]
            same = (self.keys[at] == keys[waiting]) & self.taken[at]
            found[waiting[same]] = self.values[at[same]]
            waiting = waiting[~same & self.taken[at]]
        return found


_lookups: dict[str, Lookup] = {}


def _named(keys: np.ndarray, values: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Keys and values with a name that no other broadcast of this job has."""
    return uuid.uuid4().hex, keys, values


def _lookup(held) -> Lookup:
    """The table of a broadcast, built once per worker; only the two latest are kept."""
    name, keys, values = held.value
    if name not in _lookups:
        while len(_lookups) > 1:
            del _lookups[next(iter(_lookups))]
        _lookups[name] = Lookup(keys, values)
    return _lookups[name]


def blocks(rows: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and values of a model, at most about ``block`` at a time (or a single row's)."""
    sizes = [row.n for row in rows.select("n").collect()]
    count = int(max(1, -(-sum(sizes) // block)))
    for at in range(count):
        some = rows.where(F.pmod(F.xxhash64("keys"), F.lit(count)) == at).select("keys", "logs").toArrow()
        keys = [np.frombuffer(k.as_py(), "<u8") for k in some.column("keys")]
        logs = [np.frombuffer(v.as_py(), "<f8") for v in some.column("logs")]
        yield (
            np.concatenate([*keys, np.zeros(0, np.uint64)]),
            np.concatenate([*logs, np.zeros(0)]).astype(np.float32),
        )


def _tree_score(words: list[bytes], model: Lookup, depth: int) -> float:
    return float(model.get(grams(coded(words), depth)).sum(dtype=np.float64))


def _with_columns(rows: DataFrame, added: str) -> str:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return ", ".join([*kinds, added])


def partial_scores(rows: DataFrame, held, depth: int) -> DataFrame:
    """``rows`` with the part of ``score`` that one block of the model holds added."""
    names = [name for name in rows.columns if name != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _lookup(held)
            values = batch.column("text").to_pylist()
            parts = [_tree_score(words_of(text), found, depth) for text in values]
            before = batch.column("score").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(before + np.array(parts))],
                [*names, "score"],
            )

    return rows.select(*names, "score").mapInArrow(run, _with_columns(rows.select(*names), "score double"))


def model_blocks(rows: DataFrame, found: DataFrame, depth: int, block: int) -> tuple[DataFrame, object]:
    """``rows`` with ``score`` so far, and the broadcast block of the model that is still to be
    added.  One block is the rule; each further one takes a pass and a table of its own."""
    total, last = rows.withColumn("score", F.lit(0.0)), None
    for keys, logs in blocks(found, block):
        if last is not None:
            total = written(partial_scores(total, last, depth), "context-scores")
        last = rows.sparkSession.sparkContext.broadcast(_named(keys, logs))
    return total, last


def tree_scores(rows: DataFrame, found: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Adds ``score``, the log10 probability of each coded text, to rows with ``text``."""
    total, last = model_blocks(rows, found, depth, block)
    return partial_scores(total, last, depth)


def _word_keys(words: list[bytes]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.array([one(word) | 1 for word in words], np.uint64)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): how often the rows (text) have each word, words as 63-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "c"]
            )

        for batch in batches:
            values = batch.column("text").to_pylist()
            for _, part in chunks(values, values, 2 << 20):
                fresh = np.concatenate([_word_keys(words_of(text)) for text in part])
                keys, counts = summed(
                    np.concatenate((keys, fresh)), np.concatenate((counts, np.ones(fresh.size)))
                )
                if keys.size > HELD:
                    yield sent()
                    keys, counts = keys[:0], counts[:0]
        yield sent()

    sent = rows.select("text").mapInArrow(run, "word long, c long")
    return sent.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Unigrams:
    """What the baseline knows: all counts as a table, tokens and the divisor."""

    counts: DataFrame
    texts: int
    tokens: int
    below: float

    @staticmethod
    def of(rows: DataFrame) -> Unigrams:
        """Counts of rows (text): their words, and one end per row."""
        counts = written(word_counts(rows), "base-words")
        n_texts = rows.count()
        seen = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        tokens, kinds = int(seen.n or 0) + n_texts, int(seen.v) + (n_texts > 0)
        return Unigrams(counts, n_texts, tokens, tokens + 0.1 * (kinds + 1))

    @property
    def least(self) -> float:
        """Counts from here on are frequent."""
        return self.tokens * FREQUENT


def both_scores(rows: DataFrame, model_part, base: Unigrams, depth: int) -> DataFrame:
    """(doc_id, learn, row, score, n_tokens, known, part, rare) of rows (doc_id, text, learn,
    score): the last block's part of the score, and the baseline as far as frequent words go.

    Frequent words, of which there can be no more than 1 / FREQUENT, are looked up in a
    broadcast; ``rare`` lists the others, a steady share of all tokens, and one even number for the end.
    """
    often = base.counts.where(F.col("c") >= base.least).toArrow()
    keys = often.column("word").to_numpy().view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(_named(keys, often.column("c").to_numpy()))
    below, any_text = base.below, base.texts > 0
    end = float(np.log10((base.texts + 0.1) / below))

    def one(text: str, row: int) -> tuple:
        words = words_of(text)
        hashed = _word_keys(words)
        c = _lookup(held).get(hashed)
        known = c > 0
        part = float(np.log10((c[known] + 0.1) / below).sum()) + end
        rare = np.append(hashed[~known].view(np.int64), row & ~1)  # words are odd, ends even
        score = _tree_score(words, _lookup(model_part), depth)
        return score, len(words) + 1, int(known.sum()) + any_text, part, rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = batch.column("row").to_pylist()
            found = [one(*pair) for pair in zip(batch.column("text").to_pylist(), rows_)]
            scores, sizes, known, parts, rare = list(zip(*found)) or [()] * 5
            before = batch.column("score").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("doc_id", "learn", "row")),
                    pa.array(before + np.array(scores, float)),
                    pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(parts, pa.float64()),
                    pa.array(rare, pa.list_(pa.int64())),
                ],
                ["doc_id", "learn", "row", "score", "n_tokens", "known", "part", "rare"],
            )

    given = rows.select("doc_id", "text", "learn", "score", F.xxhash64("doc_id", "text").alias("row"))
    return given.mapInArrow(
        run,
        "doc_id long, learn boolean, row long, score double, n_tokens long, known long, part double, "
        "rare array<long>",
    )


def scored(rows: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of rows
    (doc_id, text, learn).

    An empty text is its end.  Without any row to learn from every choice has probability one
    half and every word count is 0.  Rows with equal id and text get equal scores.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, min(4096, size // (16 << 20))))
    found = model(counted(rows, buckets, depth), depth)
    base = Unigrams.of(rows.where("learn"))
    total, last = model_blocks(rows, found, depth, block)
    plain = written(both_scores(total, last, base, depth), "base-rows")
    pairs = plain.select("row", F.explode("rare").alias("word"))
    # the end is in every row once: it counts rows that are equal, whose words are summed together
    is_end = F.col("word").bitwiseAND(1) == 0
    rare = base.counts.where(F.col("c") < base.least)
    met = pairs.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(is_end, 1).otherwise(0)).alias("copies"),
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("known_rare"),
        F.sum(
            F.when(~is_end, F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(base.below)))
        ).alias("part_rare"),
    )
    return plain.join(met, "row").select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.expr("known_rare div copies")).alias("n_known"),
        F.lit(base.tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("part_rare", F.lit(0.0)) / F.col("copies")).alias("base_score"),
        "score",
    )


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    """The scores of every document; those whose crc32(doc_id) modulo 10 is 0 are held out."""
    rows = texts(table(spark, sf_dir, "documents"))
    return scored(rows.withColumn("learn", share_of(F.col("doc_id"), 10) != 0))
