"""Sweeps: spec -> runs, one job over all runs, ranked result table; run logs."""

from __future__ import annotations

import json
from functools import reduce
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.operators.scoring import RATES

_MAP = "map<string,string>"


def _json_map(values: dict[str, Any]) -> Column:
    """A literal map; values stay JSON text, so 16 and "16" remain different."""
    cells = [F.lit(c) for k, v in values.items() for c in (k, json.dumps(v, ensure_ascii=False))]
    return F.create_map(*cells).cast(_MAP)


def merge_overrides(*layers: Column) -> Column:
    """Maps merged left to right; a later layer replaces an earlier key."""

    def over(early: Column, late: Column) -> Column:
        kept = F.map_filter(early, lambda k, v: ~F.array_contains(F.map_keys(late), k))
        return F.map_concat(kept, late)

    return reduce(over, layers)


def variant_label(label: Column, parts: Column) -> Column:
    """The given label, else ``key=value`` joined by ``+``, else ``base``."""
    return F.coalesce(
        F.nullif(label, F.lit("")), F.nullif(F.array_join(parts, "+"), F.lit("")), F.lit("base")
    )


def axis_names(grid: dict[str, list] | None) -> dict[str, str]:
    """Axis -> result column (its last dotted segment); two axes must not share one."""
    names = {axis: axis.split(".")[-1] for axis in grid or {}}
    taken = [*RATES, "variant", "run_id", *names.values()]
    clash = sorted({n for n in taken if taken.count(n) > 1})
    if clash:
        raise ValueError(f"result columns would overwrite each other: {clash}")
    return names


def with_grid(df: DataFrame, grid: dict[str, list] | None) -> DataFrame:
    """Every row once per grid point: adds ``combo_no`` and ``combo`` (a map).

    Each axis is a generator over its literal values, so the rows multiply inside
    their own task; there is no join.  An empty axis gives no rows, no grid one.
    """
    out = df.withColumns({"combo_no": F.lit(0), "combo": _json_map({})})
    for axis, values in (grid or {}).items():
        texts = F.array(*[F.lit(json.dumps(v, ensure_ascii=False)) for v in values]).cast(
            "array<string>"
        )
        out = (
            out.select("*", F.posexplode(texts).alias("_pos", "_text"))
            .withColumns(
                {
                    "combo_no": F.col("combo_no") * len(values) + F.col("_pos"),
                    "combo": F.map_concat("combo", F.create_map(F.lit(axis), F.col("_text"))),
                }
            )
            .drop("_pos", "_text")
        )
    return out


def with_runs(
    df: DataFrame,
    grid: dict[str, list] | None = None,
    variants: list[dict[str, Any]] | None = None,
    fixed: dict[str, Any] | None = None,
) -> DataFrame:
    """Every row once per run: adds ``run_no, label, overrides``.

    Runs are ordered by variant, then grid point.  Overrides merge in the order
    fixed, grid, variant.
    """
    points = prod(len(values) for values in (grid or {}).values())
    gridded = with_grid(df, grid)
    if not variants:
        named = gridded.withColumns(
            {"run_no": F.col("combo_no"), "label": F.lit(""), "_own": _json_map({})}
        )
    else:
        entries = []
        for at, variant in enumerate(variants):
            own = {k: v for k, v in variant.items() if k != "label"}
            parts = F.array(*[F.lit(f"{k}={v}") for k, v in own.items()]).cast("array<string>")
            entries.append(
                F.struct(
                    F.lit(at).alias("at"),
                    variant_label(F.lit(str(variant.get("label", ""))), parts).alias("label"),
                    _json_map(own).alias("own"),
                )
            )
        named = (
            gridded.select("*", F.explode(F.array(*entries)).alias("_variant"))
            .withColumns(
                {
                    "run_no": F.col("_variant.at") * points + F.col("combo_no"),
                    "label": F.col("_variant.label"),
                    "_own": F.col("_variant.own"),
                }
            )
            .drop("_variant")
        )
    return named.withColumn(
        "overrides", merge_overrides(_json_map(fixed or {}), F.col("combo"), F.col("_own"))
    ).drop("combo", "combo_no", "_own")


def expand_grid(spark: SparkSession, grid: dict[str, list] | None) -> DataFrame:
    """The grid points alone: ``combo_no, combo``."""
    return with_grid(spark.range(1).drop("id"), grid)


def expand_runs(
    spark: SparkSession,
    grid: dict[str, list] | None = None,
    variants: list[dict[str, Any]] | None = None,
    fixed: dict[str, Any] | None = None,
) -> DataFrame:
    """The run table alone: ``run_no, label, overrides``."""
    return with_runs(spark.range(1).drop("id"), grid, variants, fixed)


def sweep_results(
    runs: DataFrame, metrics: DataFrame, grid: dict[str, list] | None, variants: bool
) -> DataFrame:
    """One row per run: variant, axis columns, the four rates, run id.

    A run without metrics keeps its row, with NULL rates; metrics of an unknown run fail the job.
    """
    # one row per run of the spec on either side; the metrics are dear and computed once
    joined = runs.withColumn("_run", F.lit(True)).join(metrics, "run_no", "full_outer")
    checked = joined.where(
        F.when(F.col("_run").isNotNull(), F.lit(True)).otherwise(
            F.raise_error(F.lit("metrics of a run that the sweep does not have")).cast("boolean")
        )
    )
    axes = [F.element_at("overrides", axis).alias(name) for axis, name in axis_names(grid).items()]
    head = [F.col("label").alias("variant")] if variants else []
    return checked.select(
        "run_no", *head, *axes, "field_f1", "exact_match", "json_valid_rate", "schema_valid_rate",
        "run_id",
    )


def rank_runs(results: DataFrame) -> DataFrame:
    """Best macro F1 first, ties in run order."""
    return results.orderBy(F.desc_nulls_last("field_f1"), "run_no")


def with_place(results: DataFrame) -> DataFrame:
    """Adds the rank as a column; the table has one row per run of the spec."""
    order = Window.orderBy(F.desc_nulls_last("field_f1"), "run_no")
    return results.withColumn("place", F.row_number().over(order))


def metrics_long(summary: DataFrame, model: str = "model") -> DataFrame:
    """Wide summary rows -> ``(model, metric, value)``."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in RATES]
    )
    return summary.select(model, F.inline(cells))


def best_checkpoint(
    log: DataFrame,
    run: str = "run_id",
    step: str = "step",
    metric: str = "eval_loss",
    greater_is_better: bool = False,
) -> DataFrame:
    """Best step per run, the earliest on a tie: one aggregate, combined map-side."""
    scored = log.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    if greater_is_better:
        best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(step)).alias("s")))
        return scored.groupBy(run).agg(best.alias("_b")).select(
            run, (-F.col("_b.s")).alias(step), F.col("_b.m").alias(metric)
        )
    best = F.min(F.struct(F.col(metric).alias("m"), F.col(step).alias("s")))
    return scored.groupBy(run).agg(best.alias("_b")).select(
        run, F.col("_b.s").alias(step), F.col("_b.m").alias(metric)
    )


def retain_last(log: DataFrame, k: int, run: str = "run_id", step: str = "step") -> DataFrame:
    """The newest ``k`` checkpoints per run.

    Spark limits each run to ``k`` rows before the shuffle (window group limit), so
    a run that fills much of the log sends only ``k`` rows per task.
    """
    newest = Window.partitionBy(run).orderBy(F.desc(step))
    return log.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= k).drop("_age")


def latest_run(runs: DataFrame, run: str = "run_id", has_adapter: str = "has_adapter") -> DataFrame:
    """The last run by name that has a saved adapter."""
    return runs.where(F.col(has_adapter)).orderBy(F.desc(run)).limit(1)
