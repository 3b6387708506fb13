"""Batch prediction with a function the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Predictor = Callable[[pd.DataFrame], list[str]]


def predict(
    df: DataFrame, make_predictor: Callable[[], Predictor], batch_size: int = 4, out: str = "raw"
) -> DataFrame:
    """Adds the predictor's answer to each row.

    The predictor is made once per task, then called on batches of at most
    ``batch_size`` rows; it must give exactly one answer per row.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make_predictor()
        for part in parts:
            texts: list[str] = []
            for start in range(0, len(part), batch_size):
                rows = part.iloc[start : start + batch_size]
                given = list(predictor(rows))
                if len(given) != len(rows):
                    raise ValueError(f"{len(given)} answers for {len(rows)} rows")
                texts.extend(given)
            yield part.assign(**{out: pd.Series(texts, index=part.index, dtype=object)})

    return df.mapInPandas(answer, schema)
