"""The first samples of every evaluation step, exactly, while answers arrive in any order.

A step counts its ``n`` least indexes.  Which those are is known only in hindsight: a smaller
index that arrives later takes the place of a larger one, whose score is then taken back.  The
state of a step is the scores of its ``n`` rows, never the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldmill.operators.scoring import score, with_rates

KEYS = ("run_id", "step")
_FLAGS = ("gold_valid", "json_valid", "schema_valid", "exact_match")
_KEPT = ("index", *_FLAGS, "f1_millionths", "field_f1")
_STATE = (
    "index array<long>, gold_valid array<boolean>, json_valid array<boolean>, "
    "schema_valid array<boolean>, exact_match array<boolean>, f1_millionths array<long>, "
    "field_f1 array<double>"
)
_SUMS = (
    "run_id string, step long, n long, n_json_valid long, n_schema_valid long, n_exact_match long, "
    "f1_millionths long, f1_sum double, closed boolean"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSamples(StatefulProcessor):
    """Keeps the scores of a step's ``n`` least indexes; gives its sums whenever they change.

    An index counts once, as it arrived first.  With ``idle_ms`` a step that has had no row for so
    long in event time is closed: its last sums are given again, marked, and its state is dropped.
    """

    def __init__(self, n: int, idle_ms: int | None = None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _known(self) -> dict[int, tuple]:
        if not self.held.exists():
            return {}
        return {row[0]: row[1:] for row in zip(*self.held.get())}

    def _sums(self, key: Any, rows: dict[int, tuple], closed: bool) -> pd.DataFrame:
        counted = [rows[index][1:] for index in sorted(rows) if rows[index][0]]
        json_valid, schema_valid, exact, millionths, f1 = zip(*counted) if counted else [()] * 5
        return pd.DataFrame(
            {
                "run_id": [key[0]],
                "step": [key[1]],
                "n": [len(counted)],
                "n_json_valid": [sum(json_valid)],
                "n_schema_valid": [sum(schema_valid)],
                "n_exact_match": [sum(exact)],
                "f1_millionths": [sum(millionths)],
                "f1_sum": [float(sum(f1))],
                "closed": [closed],
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self._known()
        before, latest = set(known), 0
        for chunk in rows:
            for row in zip(*(chunk[name].tolist() for name in _KEPT)):
                known.setdefault(int(row[0]), tuple(row[1:]))
            known = {index: known[index] for index in sorted(known)[: self.n]}
            if self.idle_ms is not None:
                latest = max(latest, int(chunk["arrived"].max().timestamp() * 1000))
        if self.idle_ms is not None:
            due = max([latest + self.idle_ms, *(t for t in self.handle.listTimers())])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        if set(known) != before:
            self.held.update(tuple(map(list, zip(*((index, *known[index]) for index in sorted(known))))))
            yield self._sums(key, known, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self._known()
        self.held.clear()
        yield self._sums(key, known, True)


def least_of_tasks(stream: DataFrame, n: int) -> DataFrame:
    """Of every batch of rows in a task the ``n`` least indexes per step: all that its step can
    need, so a step that most rows belong to shuffles few of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            once = rows.drop_duplicates([*KEYS, "index"])
            first = once.sort_values("index", kind="stable").groupby(list(KEYS), dropna=False, sort=False)
            yield first.head(n)

    return stream.mapInPandas(run, stream.schema)


def first_samples(
    stream: DataFrame,
    n: int,
    schema: dict | None = None,
    arrived: str | None = None,
    idle: str = "1 hour",
) -> DataFrame:
    """Sums and rates of each step's first ``n`` samples, in update mode: every row replaces the
    one given before for its ``run_id`` and ``step``.

    Rows ``run_id, step, index, gold, raw``; a row without index is no sample, a row whose gold is
    no JSON takes its place and does not count.  With ``arrived`` (event time) a step closes
    after ``idle`` without rows; rows behind the watermark of that delay are too late.  The query
    is to be started by ``start_with_state``.
    """
    if n < 1:
        raise ValueError("at least one sample is needed")
    rows = stream.where("index IS NOT NULL")
    if arrived is not None:
        rows = rows.withColumn("arrived", F.col(arrived).cast("timestamp"))
    scored = score(rows, schema=schema)
    more = ["arrived"] if arrived is not None else []
    slim = scored.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("step").cast("long").alias("step"),
        F.col("index").cast("long").alias("index"),
        *[F.coalesce(F.col(flag), F.lit(False)).alias(flag) for flag in _FLAGS],
        F.coalesce(F.col("f1_millionths").cast("long"), F.lit(0)).alias("f1_millionths"),
        F.coalesce("field_f1", F.lit(0.0)).alias("field_f1"),
        *more,
    )
    slim = least_of_tasks(slim, n)
    idle_ms = None
    if arrived is not None:
        slim = slim.withWatermark("arrived", idle)
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    sums = slim.groupBy(*KEYS).transformWithStateInPandas(
        FirstSamples(n, idle_ms), _SUMS, "Update", "None" if arrived is None else "EventTime"
    )
    return with_rates(sums)


@contextmanager
def state_store(spark: SparkSession):
    """A query started here keeps its state in the store that arbitrary state needs; the
    session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
