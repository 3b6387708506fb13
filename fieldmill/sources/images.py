"""Image folders: manifest with sizes, and scaling down to a pixel cap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.text import plan_downscale

PIXEL_TYPE = "image_ref string, width int, height int, channels int, pixels binary"


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``image_ref, width, height, channels, pixels`` of a folder's readable images.

    The manifest lists the others with their reason.
    """
    return _read(spark, folder).where("width > 0").select(
        F.col("origin").alias("image_ref"),
        "width",
        "height",
        F.col("nChannels").alias("channels"),
        F.col("data").alias("pixels"),
    )


def read_image_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``image_ref, width, height, bad_reason`` of every file; the pixels are not carried along."""
    readable = F.col("width") > 0
    return _read(spark, folder).select(
        F.col("origin").alias("image_ref"),
        F.when(readable, F.col("width")).alias("width"),
        F.when(readable, F.col("height")).alias("height"),
        F.when(~readable, "not an image").alias("bad_reason"),
    )


def shrink(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The nearest pixel of a ``height x width x channels`` array for each of the new ones."""
    rows = np.arange(height) * pixels.shape[0] // height
    columns = np.arange(width) * pixels.shape[1] // width
    return pixels[rows[:, None], columns]


def resize_images(images: DataFrame, cap: int | None) -> DataFrame:
    """Images of more than ``cap`` pixels scaled down; all come out with three channels.

    The target size is a native expression.  Grey becomes three equal channels, a
    fourth channel is dropped.  Rows stay where they are; images go through Python
    one at a time, in small Arrow batches.
    """
    planned = images.withColumn("_to", plan_downscale(F.col("width"), F.col("height"), cap))
    sized = planned.select(
        "image_ref", "width", "height", "channels", "pixels",
        F.col("_to.width").alias("to_width"), F.col("_to.height").alias("to_height"),
    )

    def resize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                pixels = np.frombuffer(row.pixels, dtype=np.uint8).reshape(
                    row.height, row.width, row.channels
                )
                if row.channels == 1:
                    pixels = np.repeat(pixels, 3, axis=2)
                small = shrink(pixels[:, :, :3], row.to_width, row.to_height)
                rows.append((row.image_ref, row.to_width, row.to_height, 3, small.tobytes()))
            yield pd.DataFrame(rows, columns=["image_ref", "width", "height", "channels", "pixels"])

    return sized.mapInPandas(resize, PIXEL_TYPE)
