"""Toxicity: a linear model over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of hashed byte n-grams of its lower-cased words.  Every n-gram has the
logarithm of its smoothed share among toxic texts against its share among the others; the
linear model is trained on presences multiplied by these ratios.  The ratios are counted over
all labelled rows, the model is fitted on a bounded sample of them, and every row of any table
is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import filtered, share_of, table, texts, written

#: Sizes of the n-grams and of the hashed feature space (a power of two).
ORDERS = (3, 4, 5)
BITS = 20
#: At most about so many labelled rows of each class are fitted on.
PER_CLASS = 4000
#: N-grams whose log-count ratio is nearer to zero than so many standard errors are noise.
MIN_ERRORS = 3.0
#: A score from here on rejects a text.
THRESHOLD = 0.7

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


_last = np.zeros(1 << BITS, np.int32)


def features(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text, in the order of their last places."""
    data = text.lower().encode("utf-8", "replace").split()
    if not data:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8).astype(np.uint64)
    found = []
    grams = codes
    for order in range(2, max(ORDERS) + 1):
        if codes.size < order:
            break
        grams = (grams[:-1] << np.uint64(8)) | codes[order - 1 :]
        if order in ORDERS:
            salted = (grams ^ np.uint64(order << 56)) * _SPREAD
            found.append((salted >> np.uint64(64 - BITS)).astype(np.uint32))
    if not found:
        return np.zeros(0, np.uint32)
    flat = np.concatenate(found)
    place = np.arange(flat.size, dtype=np.int32)
    _last[flat] = place
    return flat[_last[flat] == place]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, clean): in how many of a task's texts of either class an n-gram is."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for label, text in zip(
            batch.column("label").to_pylist(), batch.column("text").to_pylist()
        ):
            seen[label, features(text)] += 1
    found = np.flatnonzero(seen.any(axis=0))
    columns = [found.astype(np.int32), seen[1, found], seen[0, found]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "toxic", "clean"])


@dataclass(frozen=True)
class Model:
    """One weight per hashed n-gram (the ratio multiplied in) and an intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        found = features(text)
        margin = self.intercept + float(self.weights[found].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def ratios(labelled: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(gram, ratio): log-count ratio of every n-gram of the rows (text, label) that lies at least
    MIN_ERRORS standard errors from zero."""
    counts = labelled.mapInArrow(_counts, "gram int, toxic int, clean int").groupBy("gram").agg(
        (F.sum("toxic") + 1.0).alias("t"), (F.sum("clean") + 1.0).alias("c")
    )
    n_t, n_c = F.lit(toxic + 2.0), F.lit(clean + 2.0)
    ratio = F.log(F.col("t") / n_t) - F.log(F.col("c") / n_c)
    error = F.sqrt(1 / F.col("t") - 1 / n_t + 1 / F.col("c") - 1 / n_c)
    return counts.select("gram", ratio.alias("ratio")).where(
        F.abs(ratio) >= MIN_ERRORS * F.greatest(error, F.lit(1e-9))
    )


def _train(
    kept: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rounds: int, decay: float
) -> np.ndarray:
    """Weights of the scaled presences and the intercept, by Adam on the whole sample's logistic
    loss; ``kept`` are each text's places in ``ratio``."""
    blocks = []
    for at in range(0, len(kept), 256):
        some = kept[at : at + 256]
        owner = np.repeat(np.arange(len(some), dtype=np.int32), [found.size for found in some])
        blocks.append((slice(at, at + len(some)), np.concatenate(some), owner))
    share = labels.mean()
    params = np.zeros(ratio.size + 1)
    params[-1] = np.log(share / (1 - share))
    first, second = np.zeros(params.size), np.zeros(params.size)
    for turn in range(1, rounds + 1):
        scaled = params[:-1] * ratio
        slope = np.append(decay * params[:-1], 0.0)
        for rows, flat, owner in blocks:
            margin = np.bincount(owner, scaled[flat], minlength=rows.stop - rows.start) + params[-1]
            error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels[rows]) / len(labels)
            slope[:-1] += np.bincount(flat, error[owner], minlength=ratio.size) * ratio
            slope[-1] += error.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        rate = 0.05 * (1 - turn / (rounds + 1))
        params -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return params


def fit(
    labelled: DataFrame,
    per_class: int = PER_CLASS,
    rounds: int = 200,
    decay: float = 1e-3,
) -> Model:
    """Fits on rows (doc_id, text, label); see ``fit_on``."""
    rows, marks = labelled.select("doc_id", "text"), labelled.select("doc_id", "label")
    return fit_on(rows, marks, per_class, rounds, decay)


def fit_on(
    rows: DataFrame,
    marks: DataFrame,
    per_class: int = PER_CLASS,
    rounds: int = 200,
    decay: float = 1e-3,
) -> Model:
    """Fits on rows (doc_id, text) with marks (doc_id, label), label 1 for toxic.

    The ratios are counted in Spark over all labelled ids.  About ``per_class`` ids of each class
    are taken by a hash of the id for the regression, a bounded sample however large the tables
    are; the driver gets the telling n-grams of each sampled text.  An id with several rows counts
    once, with its least text; ids without a text or a label are left out.  With one class only, or no row at all, every
    text gets the share of toxic ids (0.5 without any).
    """
    marks = marks.where("doc_id IS NOT NULL AND label IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    known = marks.join(rows.select("doc_id").distinct(), "doc_id")
    counts = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    bound = F.when(F.col("label") == 1, F.lit(int(per_class / toxic * (1 << 30)))).otherwise(
        F.lit(int(per_class / clean * (1 << 30)))
    )
    # labels grow with the documents, so both sides are shuffled whatever their size
    found = rows.join(known.hint("merge"), "doc_id").groupBy("doc_id", "label")
    found = written(found.agg(F.min("text").alias("text")), "toxicity-labelled")
    telling = ratios(found.select("text", "label"), toxic, clean).orderBy("gram").toArrow()
    sample = found.where(draw < bound).select("text", "label")
    grams = telling.column("gram").to_numpy()
    ratio = telling.column("ratio").to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[grams] = np.arange(grams.size)
    held = sample.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [held.value[features(text)] for text in batch.column("text").to_pylist()]
            kept = [np.sort(some[some >= 0]).astype("<i4").tobytes() for some in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(kept, pa.binary())], ["label", "kept"]
            )

    got = sample.mapInArrow(run, "label int, kept binary").toArrow()
    found = sorted(zip(got.column("label").to_pylist(), got.column("kept").to_pylist()))
    labels = np.array([label for label, _ in found], np.float64)
    params = _train([np.frombuffer(k, "<i4") for _, k in found], labels, ratio, rounds, decay)
    weights = np.zeros(1 << BITS, np.float32)
    weights[grams] = params[:-1] * ratio
    # the sample is drawn by class; the intercept goes back to the share in the table
    share = labels.mean()
    shift = np.log(toxic / clean) - np.log(share / (1 - share))
    return Model(weights, float(params[-1] + shift))


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text), blank texts included.

    The weights that travel to the executors have a fixed size (2**BITS numbers).
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            found = [model.score(value) for value in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def learned(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the documents whose crc32(doc_id) modulo 3 is not 1."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    return fit_on(texts(documents).where(share_of(F.col("doc_id"), 3) != 1), marks)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    documents = table(spark, sf_dir, "documents")
    model = learned(documents, table(spark, sf_dir, "labels"))
    return score(texts(documents), model).select(
        "doc_id",
        (share_of(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept; a stage's filter.

    Every row is judged by its own text, null texts as empty ones.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda: lambda text: held.value.score(text) < THRESHOLD)
