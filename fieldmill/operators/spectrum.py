"""Singular values of tall groups of vectors, by a tree of QR factors.

A group's vectors are the rows of a matrix.  Every task folds its rows into one triangular
factor per group; factors of a group are stacked and factored again, a bounded number at a
time, until few are left.  Nothing is squared on the way, so a value of 1e-10 of the largest
is as good as numpy's, and no task holds more than a few factors of d x d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators.vectors import ENERGY_SHARE
from fieldmill.session import work_folder

#: Factors a task holds at a time, in bytes; it decides how many are merged in one step.
HELD_BYTES = 128 << 20


def _factor(top: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``rows`` below ``top``."""
    return np.linalg.qr(rows if top is None else np.vstack([top, rows]), mode="r")


def _matrix(cell: bytes, size: int) -> np.ndarray:
    return np.frombuffer(cell, "<f8").reshape(-1, size)


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    place = work_folder(df.sparkSession, purpose)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def triangular_factors(df: DataFrame, vector: str, group: str, held: int = HELD_BYTES) -> DataFrame:
    """(group, part, size, factor): one factor per task and group, more only where a task's
    open factors exceed ``held`` bytes.  ``part`` names a row; a retried task repeats it.

    Vectors that are null, empty or hold a null take no part; a group's vectors must have
    one length.  Null is a group of its own.
    """
    kind = df.schema[group].dataType.simpleString()
    whole = (
        F.col(vector).isNotNull()
        & (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull())
    )
    rows = df.where(whole).select(group, F.col(vector).cast("array<double>").alias(vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        tops: dict = {}
        made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name, top in tops.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name], names.type),
                        pa.array([first + made], pa.int64()),
                        pa.array([top.shape[1]], pa.int32()),
                        pa.array([top.astype("<f8").tobytes()], pa.binary()),
                    ],
                    [group, "part", "size", "factor"],
                )
                made += 1
            tops.clear()

        for batch in batches:
            names, vectors = batch.column(0), batch.column(1)
            coded = names.dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                places = np.flatnonzero(codes == code)
                size = len(vectors[int(places[0])])
                for at in range(0, places.size, max(2 * size, 256)):
                    some = vectors.take(pa.array(places[at : at + max(2 * size, 256)]))
                    top = tops.get(name)
                    if pc.unique(some.value_lengths()).to_pylist() != [size if top is None else top.shape[1]]:
                        raise ValueError(f"vectors of group {name!r} differ in length")
                    cells = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    tops[name] = _factor(top, cells)
                if sum(top.nbytes for top in tops.values()) > held:
                    yield from flush()
        if tops:
            yield from flush()

    return rows.mapInArrow(run, f"{group} {kind}, part long, size int, factor binary")


def singular_spectrum(df: DataFrame, vector: str, group: str, held: int = HELD_BYTES) -> DataFrame:
    """``energy_spectrum`` without its loss of small values: (group, component, sigma, energy,
    components_90), one row per dimension; a group with fewer vectors than dimensions ends in
    zeros.  Memory of a task: ``held`` bytes of factors, or two factors where those are larger.

    Each level of the tree is a table in the shared folder, so a lost executor costs a part of
    one level.  Their number is the logarithm of the tasks to the base of the factors that
    fit: one or two up to some hundred dimensions.
    """
    kind = df.schema[group].dataType.simpleString()
    level = _stored(triangular_factors(df, vector, group, held), "factors")

    def merged(table: pa.Table) -> tuple[np.ndarray, int]:
        sizes = set(table.column("size").to_pylist())
        if len(sizes) > 1:
            raise ValueError(f"vectors of group {table.column(group)[0].as_py()!r} differ in length")
        size, top = sizes.pop(), None
        parts = np.argsort(table.column("part").to_numpy())  # the same order whatever arrives first
        for at in parts.tolist():
            top = _factor(top, _matrix(table.column("factor")[at].as_py(), size))
        return top, size

    def join(table: pa.Table) -> pa.Table:
        top, size = merged(table)
        return pa.table(
            {
                group: table.column(group).slice(0, 1),
                "part": pa.array([pc.min(table.column("part")).as_py()], pa.int64()),
                "size": pa.array([size], pa.int32()),
                "factor": pa.array([top.astype("<f8").tobytes()], pa.binary()),
            }
        )

    def finish(table: pa.Table) -> pa.Table:
        top, size = merged(table)
        sigma = np.zeros(size)
        found = np.linalg.svd(top, compute_uv=False)
        sigma[: found.size] = found
        energy = sigma * sigma
        share = np.cumsum(energy) / max(energy.sum(), np.finfo(float).tiny)
        name = table.column(group)[0].as_py()
        return pa.table(
            {
                group: pa.array([name] * size, table.schema.field(group).type),
                "component": pa.array(np.arange(1, size + 1, dtype=np.int32)),
                "sigma": pa.array(sigma),
                "energy": pa.array(share),
                "components_90": pa.array([int((share < ENERGY_SHARE).sum()) + 1] * size, pa.int32()),
            }
        )

    while True:
        found = level.groupBy(group).agg(F.count("*").alias("n"), F.max("size").alias("size"))
        row = found.agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
        fan = max(2, held // (8 * (row.size or 1) ** 2))
        if (row.n or 0) <= fan:
            break
        order = Window.partitionBy(group).orderBy("part")
        slots = level.select(group, "part").select(
            "part", F.floor((F.row_number().over(order) - 1) / fan).alias("slot")
        )
        level = _stored(
            level.join(slots, "part")
            .groupBy(group, "slot")
            .applyInArrow(join, f"{group} {kind}, part long, size int, factor binary"),
            "factors",
        )
    return level.groupBy(group).applyInArrow(
        finish, f"{group} {kind}, component int, sigma double, energy double, components_90 int"
    )
