"""Vector statistics: group norms, sums by name class, singular value spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name classes in order of precedence, share of energy asked for.
NAME_CLASSES = {
    "attention": ("attn", "attention"),
    "mlp/experts": ("mlp", "expert", "ffn", "feed_forward"),
}
OTHER_CLASS = "other"
ENERGY_SHARE = 0.9

# Memory a task may hold in Gram matrices before it passes them on.
_OPEN_BYTES = 128 << 20


def group_norms(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Frobenius norm of all vectors of a group; partial sums leave each task."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return df.groupBy(key).agg(F.sqrt(F.sum(squares)).alias("norm"))


def top_norms(norms: DataFrame, key: str, n: int = 25) -> DataFrame:
    """The ``n`` largest norms, ties by descending name."""
    return norms.orderBy(F.desc("norm"), F.desc(key)).limit(n)


def name_class(name: Column) -> Column:
    """First class one of whose words occurs in the name."""
    found = F.lit(OTHER_CLASS)
    for label, words in reversed(NAME_CLASSES.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(name, F.lit(word))
        found = F.when(hit, F.lit(label)).otherwise(found)
    return found


def norms_by_class(norms: DataFrame, key: str) -> DataFrame:
    return norms.groupBy(name_class(F.col(key)).alias("name_class")).agg(
        F.sum("norm").alias("norm")
    )


def energy_spectrum(df: DataFrame, vector: str, group: str) -> DataFrame:
    """Singular values per group with cumulative energy and the count that reaches 90 %.

    Each task folds its vectors into one d x d Gram matrix per group and emits its
    upper triangle; cells are summed by Spark.  What reaches the last step per
    group is d*(d+1)/2 numbers, however many vectors the group has.  Squaring costs
    precision: singular values below about 1e-8 of the largest are noise.
    """
    kind = df.schema[group].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict = {}

        def flush() -> Iterator[pd.DataFrame]:
            for name, gram in grams.items():
                i, j = np.triu_indices(len(gram))
                yield pd.DataFrame({group: name, "i": i, "j": j, "cell": gram[i, j]})
            grams.clear()

        for batch in batches:
            for name, rows in batch.groupby(group, sort=False):
                matrix = np.stack(rows[vector].to_numpy()).astype(np.float64)
                gram = matrix.T @ matrix
                grams[name] = grams[name] + gram if name in grams else gram
            if sum(gram.nbytes for gram in grams.values()) > _OPEN_BYTES:
                yield from flush()
        yield from flush()

    def spectrum(cells: pd.DataFrame) -> pd.DataFrame:
        size = int(cells["j"].max()) + 1
        gram = np.zeros((size, size))
        gram[cells["i"], cells["j"]] = cells["cell"]
        gram[cells["j"], cells["i"]] = cells["cell"]
        energy = np.clip(np.linalg.eigvalsh(gram)[::-1], 0.0, None)
        share = np.cumsum(energy) / max(energy.sum(), np.finfo(float).tiny)
        return pd.DataFrame(
            {
                group: cells[group].iloc[0],
                "component": np.arange(1, size + 1),
                "sigma": np.sqrt(energy),
                "energy": share,
                "components_90": int((share < ENERGY_SHARE).sum()) + 1,
            }
        )

    partial = df.select(group, vector).mapInPandas(
        fold, f"{group} {kind}, i int, j int, cell double"
    )
    return (
        partial.groupBy(group, "i", "j")
        .agg(F.sum("cell").alias("cell"))
        .groupBy(group)
        .applyInPandas(
            spectrum,
            f"{group} {kind}, component int, sigma double, energy double, components_90 int",
        )
    )
