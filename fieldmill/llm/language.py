"""Language ID by hyperdimensional profiles.

Every letter, of any script, has a random vector of -1 and 1 of its own.  A trigram's vector
binds (multiplies) the vectors of its letters, permuted (rolled) by their place; a text's vector
bundles (adds) its trigrams' vectors, and a language's prototype bundles its texts.  A text gets
the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import share_of, table, texts

DIMENSIONS = 512
#: Trigrams of the gap between words (0) and a to z (1 to 26) are numbers in this base; those
#: with any other letter, which is its code point, are negative.
CLASSES = 64
UNDETERMINED = "und"
_BITS = 21

_vectors: list[np.ndarray] = []
_classes: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Number of every code point: 0 for what is no letter, 1 to 26 for a to z, else itself."""
    if not _classes:
        found = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            if chr(code).isalpha():
                found[code] = code
        # letters beyond a to z start far above the base; capitals are gone by then
        found[: CLASSES * 2] = 0
        for code in range(26):
            found[ord("a") + code] = code + 1
        _classes.append(found)
    return _classes[0]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of gap and a to z: bound pairs (first letter twice rolled, second once) and letters."""
    if not _vectors:
        draws = np.random.Generator(np.random.PCG64(20))
        letter = draws.integers(0, 2, (CLASSES, DIMENSIONS), np.int8) * 2 - 1
        first, second = np.roll(letter, 2, axis=1), np.roll(letter, 1, axis=1)
        _vectors.extend(((first[:, None, :] * second[None]).reshape(-1, DIMENSIONS), letter))
    return _vectors[0], _vectors[1]


@lru_cache(maxsize=1 << 14)
def letter_vector(number: int) -> np.ndarray:
    """The vector of a letter; beyond a to z it is drawn from the code point alone, so every task
    has the same.  Held for the last 16,384 letters (8 MB), drawn again beyond."""
    if number < CLASSES:
        return _tables()[1][number]
    draws = np.random.Generator(np.random.PCG64([20, number]))
    return draws.integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def trigrams(text: str) -> np.ndarray:
    """Codes of all letter trigrams of a text, gaps collapsed to one; empty without a letter."""
    lowered = text.lower().encode("utf-32-le", "surrogatepass")
    found = _letters()[np.frombuffer(lowered, "<u4")]
    found = np.concatenate(([0], found, [0]))
    found = found[1:][(found[1:] != 0) | (found[:-1] != 0)].astype(np.int64)
    if not found.any():
        return np.zeros(0, np.int64)
    found = np.concatenate(([0], found, [0] if found[-1] else [])).astype(np.int64)
    a, b, c = found[:-2], found[1:-1], found[2:]
    codes = (a * CLASSES + b) * CLASSES + c
    wide = (a | b | c) >= CLASSES
    if wide.any():
        codes[wide] = -1 - ((((a << _BITS) | b) << _BITS) | c)[wide]
    return codes


def bound(codes: np.ndarray) -> np.ndarray:
    """One vector per trigram: its letters' vectors, rolled by place and multiplied."""
    pairs, last = _tables()
    wide = codes < 0
    plain = np.where(wide, 0, codes)
    vectors = pairs[plain // CLASSES] * last[plain % CLASSES]
    if wide.any():
        packed = -1 - codes[wide]
        mask = (1 << _BITS) - 1
        parts = np.stack([packed >> 2 * _BITS, (packed >> _BITS) & mask, packed & mask])
        numbers, at = np.unique(parts, return_inverse=True)
        letter = np.stack([letter_vector(int(n)) for n in numbers])
        one, two, three = at.reshape(parts.shape)
        vectors[wide] = (
            np.roll(letter, 2, axis=1)[one] * np.roll(letter, 1, axis=1)[two] * letter[three]
        )
    return vectors


def bundle(codes: np.ndarray, counts: np.ndarray, block: int = 4096) -> np.ndarray:
    """Sum of the trigrams' vectors, in blocks so that memory stays bounded."""
    total = np.zeros(DIMENSIONS)
    for at in range(0, codes.size, block):
        vectors = bound(codes[at : at + block])
        total += counts[at : at + block].astype(np.float32) @ vectors.astype(np.float32)
    return total


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(trigrams(text), return_counts=True)


class _Profile:
    """The exact bundle of many texts: trigrams of a to z as a table of counts, the others, of
    which there is no small number, gathered and added up whenever they are many."""

    MANY = 1 << 17

    def __init__(self) -> None:
        self.plain = np.zeros(CLASSES**3, np.int64)
        self.total = np.zeros(DIMENSIONS, np.int64)
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        first = int(np.searchsorted(codes, 0))  # sorted: the negative ones come first
        self.plain[codes[first:]] += counts[first:]
        if first:
            self.codes.append(codes[:first])
            self.counts.append(counts[:first])
            self.size += first
            if self.size >= self.MANY:
                self._settle()

    def _settle(self) -> None:
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        self._sum(codes, np.bincount(at, np.concatenate(self.counts)).astype(np.int64))
        self.codes, self.counts, self.size = [], [], 0

    def _sum(self, codes: np.ndarray, counts: np.ndarray) -> None:
        for at in range(0, codes.size, 2048):
            self.total += (bound(codes[at : at + 2048]) * counts[at : at + 2048, None]).sum(0)

    def vector(self) -> np.ndarray:
        if self.codes:
            self._settle()
        codes = np.flatnonzero(self.plain)
        self._sum(codes, self.plain[codes])
        self.plain[:] = 0
        return self.total


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """One bundled vector per language of rows (text, lang); null languages teach nothing.

    Each task counts its trigrams per language and sends one vector per language; Spark adds
    them up.  What reaches the driver is one vector per language, however many texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Profile] = {}
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            for text, lang in pairs:
                codes, n = _counted(text)
                if codes.size:
                    held.setdefault(lang, _Profile()).add(codes, n)
        for lang, profile in held.items():
            vector = profile.vector()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * DIMENSIONS),
                    pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                    pa.array(vector),
                ],
                ["lang", "at", "value"],
            )

    sums = (
        labelled.where(F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(run, "lang string, at int, value long")
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("values"))
    )
    return {
        row.lang: np.array([cell.value for cell in row["values"]], np.float64)
        for row in sums.orderBy("lang").collect()
    }


def identify(df: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text).

    The score is the cosine, not below 0.  A text without a letter, or any text when no
    language is known, is ``und`` with score 0; of equal cosines the first name wins.
    """
    names = sorted(known)
    matrix = np.array([known[name] for name in names]).reshape(len(names), DIMENSIONS)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    held = df.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                codes, counts = _counted(text)
                lang, cosine = UNDETERMINED, 0.0
                if codes.size and names:
                    vector = bundle(codes, counts)
                    cosines = matrix @ vector / max(float(np.linalg.norm(vector)), 1e-12)
                    best = int(np.argmax(cosines))
                    lang, cosine = names[best], float(np.clip(cosines[best], 0, 1))
                langs.append(lang)
                scores.append(cosine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Null and empty texts and those without a letter are ``und`` with score 0; rows with equal or
    null ids each have their own result, a null id counting as held out or not by the empty text.
    """
    documents = table(spark, sf_dir, "documents")
    held_out = share_of(F.col("doc_id").cast("long"), 4) == 2
    learned_from = documents.where(~held_out).select(
        F.coalesce("text", F.lit("")).alias("text"), "lang"
    )
    found = identify(texts(documents), prototypes(learned_from))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
