"""Names for datasets and metrics, so jobs and SQL can refer to them by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession

Splits = dict[str, DataFrame]
Builder = TypeVar("Builder", bound=Callable[..., Splits])
Metric = TypeVar("Metric", bound=Callable[..., Column | dict[str, Column]])

_datasets: dict[str, Callable[..., Splits]] = {}
_metrics: dict[str, Callable[..., Column | dict[str, Column]]] = {}


def register_dataset(name: str) -> Callable[[Builder], Builder]:
    """Registers ``builder(spark, **options) -> {split: DataFrame}``; a name is taken once."""

    def keep(builder: Builder) -> Builder:
        if name in _datasets:
            raise ValueError(f"dataset {name!r} is registered already")
        _datasets[name] = builder
        return builder

    return keep


def list_datasets() -> list[str]:
    return sorted(_datasets)


def open_dataset(spark: SparkSession, name: str, **options: object) -> Splits:
    """The dataset's splits, each also published as a temporary view ``<name>_<split>``."""
    if name not in _datasets:
        raise KeyError(f"no dataset {name!r}; registered are {list_datasets()}")
    splits = _datasets[name](spark, **options)
    for split, df in splits.items():
        df.createOrReplaceTempView(f"{name}_{split}")
    return splits


def register_metric(name: str) -> Callable[[Metric], Metric]:
    """Registers a scoring function over columns; the last registration of a name wins."""

    def keep(metric: Metric) -> Metric:
        _metrics[name] = metric
        return metric

    return keep


def get_metric(name: str) -> Callable[..., Column | dict[str, Column]]:
    if name not in _metrics:
        raise KeyError(f"no metric {name!r}; registered are {sorted(_metrics)}")
    return _metrics[name]
