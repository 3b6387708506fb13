"""Substring dedup: every window of words that also starts in an earlier document goes.

Windows are hashed by a rolling polynomial over word hashes (Rabin-Karp).  A task settles
what repeats among its own documents and sends, per distinct window, one occurrence of its
smallest document; Spark brings equal hashes together by buckets, where the smallest
document of each is found.  Only windows that must go are sent back, as places in their
documents; overlapping ones merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import release, stretches, table, texts, without, word_spans, written

WINDOW = 13
#: Bytes of text whose windows meet in one bucket, on average.
BUCKET_BYTES = 12 << 20
#: Bytes of text that a task settles at once.
CHUNK = 2 << 20

_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What a null id counts as: the last document.
_LAST = (1 << 63) - 1


def word_hashes(text: str) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.array([one(word) for word in text.encode("utf-8", "replace").split()], np.uint64)


def rolling(words: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``window`` consecutive values."""
    n = words.size - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for at in range(1, window):
        total *= base
        total += words[at : at + n]
    return total


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = steps.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T)
    return np.cumsum(steps.view(kind).ravel(), dtype=kind)


def _runs(values: np.ndarray) -> list[np.ndarray]:
    """Indices of each run of equal values."""
    if not values.size:
        return []
    return np.split(np.arange(values.size), np.flatnonzero(np.diff(values)) + 1)


_PARTS = ["docs", "twins", "ends", "places"]
_SENT_SQL = "bucket long, chunk long, hashes binary, " + ", ".join(f"{p} binary" for p in _PARTS)
_REPLY_SQL = "chunk long, " + ", ".join(f"{p} binary" for p in _PARTS)


def _places(number: np.ndarray, twin: np.ndarray, place: np.ndarray) -> tuple:
    """Places of windows, in order of document and place, as the columns _PARTS."""
    begins = np.flatnonzero(
        np.concatenate(([True], (number[1:] != number[:-1]) | (twin[1:] != twin[:-1])))
    )
    ends = np.append(begins[1:], number.size).astype("<u4")
    docs = number[begins].astype("<i8")
    return _pack(docs), twin[begins].astype("<u4").tobytes(), _pack(ends), _pack(place.astype("<u4"))


def _unplaced(docs: bytes, twins: bytes, ends: bytes, places: bytes) -> tuple:
    counts = np.diff(_unpack(ends, "<u4"), prepend=np.uint32(0))
    return (
        np.repeat(_unpack(docs, "<i8"), counts),
        np.repeat(np.frombuffer(twins, "<u4"), counts),
        _unpack(places, "<u4"),
    )


def _chunk_rows(ids: list[int], values: list[str], window: int, buckets: int) -> Iterator[tuple]:
    """What a chunk sends: (bucket, chunk, hashes, *_PARTS) of the windows that other chunks must
    be asked about, and one such row without hashes of the windows that are settled here."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    number = np.array([ids[i] for i in order], np.int64)
    values = [values[i] for i in order]
    twins = np.array([zlib.crc32(v.encode("utf-8", "replace")) for v in values], "<u4")
    chunk = xxhash.xxh64_intdigest(number.tobytes() + twins.tobytes())
    home, chunk = chunk % buckets, int(np.uint64(chunk).view(np.int64))
    hashed = [word_hashes(value) for value in values]
    sizes = np.array([h.size for h in hashed], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    del hashed, values
    doc = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    hashes = rolling(words, window, _BASE)
    whole = np.flatnonzero(doc[: hashes.size] == doc[doc.size - hashes.size :])
    hashes, doc = hashes[whole], doc[whole]
    place = (whole - starts[doc]).astype(np.uint32)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    smallest = number[doc[first]]

    gone = np.flatnonzero(number[doc] > smallest[group])
    if gone.size:
        yield home, chunk, None, *_places(number[doc[gone]], twins[doc[gone]], place[gone])

    sent = np.zeros(hashes.size, bool)
    sent[first] = True
    # rows that share an id are one document to each other; each needs its own answer
    others = np.flatnonzero((number[doc] == smallest[group]) & (doc != doc[first][group]))
    _, once = np.unique(group[others] * np.int64(sizes.size) + doc[others], return_index=True)
    sent[others[once]] = True
    del group, first, smallest, others
    sent = np.flatnonzero(sent)
    bucket = (rolling(words, window, _OTHER)[whole[sent]] >> np.uint64(24)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    for at in _runs(bucket[by]):
        some = sent[by[at]]
        parts = _places(number[doc[some]], twins[doc[some]], place[some])
        yield int(bucket[by[at[0]]]), chunk, hashes[some].tobytes(), *parts


def _batch(ids: list[int], values: list[str], window: int, buckets: int) -> pa.RecordBatch:
    names = ["bucket", "chunk", "hashes", *_PARTS]
    columns = list(zip(*_chunk_rows(ids, values, window, buckets))) or [()] * len(names)
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, one row per row that came in and has something to remove: what a chunk had
    settled, and those of its windows that a smaller document has."""
    rows = [tuple(row) for row in group.loc[group["hashes"].isna(), ["chunk", *_PARTS]].to_numpy()]
    asked = group[group["hashes"].notna()]
    if len(asked):
        parts = [_unplaced(*row) for row in asked[_PARTS].to_numpy()]
        sender = np.repeat(np.arange(len(parts)), [part[0].size for part in parts])
        number, twin, place = (np.concatenate(column) for column in zip(*parts))
        del parts
        hashes = np.frombuffer(b"".join(asked["hashes"]), np.uint64)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        smallest = np.minimum.reduceat(number[order], begins)
        smallest = np.repeat(smallest, np.diff(begins, append=order.size))
        gone = np.sort(order[number[order] > smallest])
        chunk = asked["chunk"].to_numpy()
        for at in _runs(sender[gone]):
            some = gone[at]
            rows.append((int(chunk[sender[some[0]]]), *_places(number[some], twin[some], place[some])))
    return pd.DataFrame(rows, columns=["chunk", *_PARTS])


def _per_document(group: pd.DataFrame) -> pd.DataFrame:
    """The answers to one chunk, as one row per document."""
    parts = [_unplaced(*row) for row in group[_PARTS].to_numpy()]
    number, twin, place = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((place, twin, number))
    number, twin, place = number[order], twin[order], place[order]
    starts = np.flatnonzero(
        np.concatenate(([True], (number[1:] != number[:-1]) | (twin[1:] != twin[:-1])))
    )
    rows = [
        (int(number[a]), int(twin[a]), _pack(place[a:b]))
        for a, b in zip(starts, np.append(starts[1:], number.size))
    ]
    return pd.DataFrame(rows, columns=["number", "twin", "places"])


def marked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(number, twin, marks): per row of (doc_id, text) with something to remove, packed starts
    of its windows that also start in a row with a smaller id.

    Null ids come after all others.  The table of marks lies in the shared folder.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, -(-total // BUCKET_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches, CHUNK):
            ids = [_LAST if i is None else i for i in batch.column("doc_id").to_pylist()]
            yield _batch(ids, batch.column("text").to_pylist(), window, buckets)
        release()

    found = (
        docs.select("doc_id", "text")
        .mapInArrow(run, _SENT_SQL)
        .groupBy("bucket")
        .applyInPandas(_answered, _REPLY_SQL)
        .groupBy("chunk")
        .applyInPandas(_per_document, "number long, twin long, places binary")
        .groupBy("number", "twin")
        .agg(F.collect_list("places").alias("marks"))
    )
    return written(found, "substring-marks")


def covered(text: str, places: list[bytes], window: int) -> np.ndarray:
    """For every word of a text whether a marked window covers it.

    A mark stands for every window of the text with the same words.
    """
    hashes = rolling(word_hashes(text), window, _BASE)
    starts = np.unique(np.concatenate([_unpack(some, "<u4") for some in places]))
    starts = np.flatnonzero(np.isin(hashes, hashes[starts]))
    steps = np.zeros(hashes.size + window, np.int64)
    steps[starts] += 1
    steps[starts + window] -= 1
    return np.cumsum(steps)[:-1] > 0


def intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words as (first, behind the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def without_intervals(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words of the intervals and the blanks that follow them."""
    data = text.encode("utf-8", "replace")
    starts, _ = word_spans(data)
    kept, at = [], 0
    for first, behind in gone:
        kept.append(data[at : starts[first]])
        at = starts[behind] if behind < starts.size else len(data)
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def _finished(docs: DataFrame, window: int, finish, schema: pa.Schema, sql: str) -> DataFrame:
    """``finish(text, marks)`` per row, after the join of rows with their marks.  Columns of
    ``docs`` other than doc_id and text are handed through."""
    keyed = docs.select(
        "*",
        F.coalesce("doc_id", F.lit(_LAST)).alias("__number"),
        F.crc32(F.col("text").cast("binary")).alias("__twin"),
    )
    marks = marked(docs, window).toDF("__number", "__twin", "__marks")
    found = keyed.join(marks, ["__number", "__twin"], "left").select(*docs.columns, "__marks")
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            pairs = zip(batch.column("text").to_pylist(), batch.column("__marks").to_pylist())
            columns = list(zip(*(finish(text, places) for text, places in pairs)))
            columns = columns or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others]
                + [pa.array(c, field.type) for c, field in zip(columns, schema)],
                others + schema.names,
            )
        release()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return found.mapInArrow(run, f"{kept}, {sql}")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text).

    A null text has no words; rows with equal ids count as one document to each other.
    """

    def finish(text: str, places: list[bytes] | None) -> tuple[int, int, str]:
        words = text.encode("utf-8", "replace").split()
        kept = words
        if places:
            gone = covered(text, places, window)
            kept = [word for word, off in zip(words, gone.tolist()) if not off]
        digest = hashlib.sha256(b" ".join(kept)).hexdigest()
        return len(words), len(words) - len(kept), digest

    schema = pa.schema(
        [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    )
    sql = "n_words long, n_removed long, kept_sha256 string"
    return _finished(docs.select("doc_id", "text"), window, finish, schema, sql)


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text, ...) with the repeated words cut from the text, and ``spans``: the
    removed intervals as [first word, word behind the last].

    Blanks between kept words stay; a text with nothing to remove stays as it is.
    """

    def finish(text: str, places: list[bytes] | None) -> tuple[str, list[list[int]]]:
        if not places:
            return text, []
        gone = intervals(covered(text, places, window))
        return without_intervals(text, gone), [list(span) for span in gone]

    schema = pa.schema([("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
    return _finished(without(docs, "spans"), window, finish, schema, "text string, spans array<array<int>>")


def rewritten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` rows with cut texts and their new ``n_chars``; a stage's filter.

    All columns and rows stay; null texts stay null, and a text may end up empty.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    before = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*every).alias("row"),
    )
    cut = F.size("spans") > 0
    new = {
        "text": F.when(cut, F.col("text")).otherwise(F.col("row.text")),
        "n_chars": F.when(cut, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
        if "n_chars" in docs.columns
        else None,
    }
    after = cleaned(before, window)
    return after.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return digests(texts(table(spark, sf_dir, "documents")))


#: Every window with the smallest document it starts in, and the words that are left.
OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, r, i, list_slice(w, i, i + 12) AS words
  FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT words, min(doc_id) AS smallest FROM windows GROUP BY words),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (words) WHERE doc_id > smallest),
taken AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
left_over AS (
  SELECT doc_id, len(w) AS n_words,
    list_filter(w, lambda x, k: NOT list_contains(coalesce(gone, []), k)) AS kept
  FROM docs LEFT JOIN taken USING (r))
SELECT doc_id, n_words, n_words - len(kept) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM left_over
"""
