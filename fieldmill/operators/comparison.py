"""Baseline against adapter on the same rows: differences with bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.draws import cut, digest
from fieldmill.operators.scoring import zip_strict

#: Rates of a summary and what a row adds to them, in millionths.
MEASURES = {
    "json_valid_rate": "json_valid",
    "schema_valid_rate": "schema_valid",
    "field_f1": "f1_millionths",
    "exact_match": "exact_match",
}
#: Of 65,536 draws so many lie below 1, 2, 3, ... in a Poisson distribution of mean 1.
POISSON = (24109, 48219, 60273, 64291, 65296, 65497, 65530)
#: Weights that one digest gives.
_DRAWS = 8


def _millionths(column: str) -> Column:
    if column == "f1_millionths":
        return F.col(column).cast("bigint")
    return F.col(column).cast("bigint") * 1_000_000


def paired(baseline: DataFrame, adapter: DataFrame, on: str = "index") -> DataFrame:
    """One row per index with both models' measures in millionths, as arrays in the order of
    MEASURES.  The job fails where one side lacks an index or has it twice; rows whose gold is no
    JSON count on neither side."""

    def side(scored: DataFrame, name: str) -> DataFrame:
        values = F.array(*map(_millionths, MEASURES.values()))
        return scored.where("gold_valid").select(F.col(on), values.alias(name))

    return zip_strict(side(baseline, "_b"), side(adapter, "_a"), on)


def _weight(drawn: Column) -> Column:
    total = F.lit(0)
    for bound in POISSON:
        total = total + (drawn >= bound).cast("int")
    return total


def compare_paired(
    baseline: DataFrame,
    adapter: DataFrame,
    on: str = "index",
    replicates: int = 200,
    level: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """``metric, n, baseline, adapter, delta, low, high``: mean measures of scored rows and the
    interval of their difference over Poisson bootstrap replicates.

    A row's weight in a replicate comes from an md5 of its key, so the replicates are drawn where
    the row is, whatever the partitioning, and one aggregate, combined before its shuffle, sums
    all of them: replicate 0 weighs every row once.  Sums are whole numbers.  A replicate that
    drew no row is left out; no rows give NULL.
    """
    if replicates < 2 or not 0 < level < 1:
        raise ValueError("at least two replicates and a level between 0 and 1 are needed")
    blocks = -(-replicates // _DRAWS)
    rows = paired(baseline, adapter, on).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hexed = digest(f"bootstrap-{seed}", F.col(on), F.col("block"))
    # arrays of what was drawn, so that no element computes its digest again
    numbers = F.transform(cut(hexed, 4), lambda piece: F.conv(piece, 16, 10).cast("int"))
    weights = F.transform(
        numbers,
        lambda number, i: F.struct(
            (F.col("block") * _DRAWS + i + 1).alias("replicate"), _weight(number).alias("w")
        ),
    )
    once = F.array(F.struct(F.lit(0).alias("replicate"), F.lit(1).alias("w")))
    drawn = rows.select(
        "_b", "_a", F.inline(F.when(F.col("block") == 0, F.concat(once, weights)).otherwise(weights))
    )
    sums = drawn.where(F.col("replicate") <= replicates).groupBy("replicate").agg(
        F.sum("w").alias("n"),
        *[F.sum(F.col("w") * F.col(side)[i]).alias(f"{side}{i}") for side in ("_b", "_a") for i in range(len(MEASURES))],
    )
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(f"_b{i}").alias("b"), F.col(f"_a{i}").alias("a"))
            for i, name in enumerate(MEASURES)
        ]
    )
    each = sums.where("n > 0").select("replicate", "n", F.inline(cells))
    change = (F.col("a") - F.col("b")) / F.col("n") / 1_000_000
    whole = F.col("replicate") == 0
    # one number per replicate and metric
    found = each.groupBy("metric").agg(
        F.max(F.when(whole, F.col("n"))).alias("n"),
        F.max(F.when(whole, F.col("b") / F.col("n") / 1_000_000)).alias("baseline"),
        F.max(F.when(whole, F.col("a") / F.col("n") / 1_000_000)).alias("adapter"),
        F.max(F.when(whole, change)).alias("delta"),
        F.array_sort(F.collect_list(F.when(~whole, change))).alias("_changes"),
    )
    outside = F.floor(F.size("_changes") * ((1 - level) / 2) + 1e-9).cast("int")
    return found.select(
        "metric",
        "n",
        *[F.round(name, 6).alias(name) for name in ("baseline", "adapter", "delta")],
        F.round(F.get("_changes", outside), 6).alias("low"),
        F.round(F.get("_changes", F.size("_changes") - 1 - outside), 6).alias("high"),
    )
