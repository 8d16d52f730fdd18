"""Model inference as a batch function, and what is derived from its output.

Models are given by the caller: a function of no arguments that loads one and returns
a function of image batches. It is called once in each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config

Batch = Callable[[list[np.ndarray]], list[np.ndarray]]


def _images(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(d, np.uint8).reshape(h, w, c) for d, h, w, c in zip(frame["data"], frame["height"], frame["width"], frame["nChannels"], strict=True)]


def _predict(crops: DataFrame, load: Callable[[], Batch], column: str, kind: str, size: int) -> DataFrame:
    @F.pandas_udf(f"array<{kind}>")
    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for frame in frames:
            out: list[np.ndarray] = []
            for start in range(0, len(frame), size):
                out += [np.asarray(y).reshape(-1) for y in model(_images(frame.iloc[start : start + size]))]
            yield pd.Series(out)

    return crops.withColumn(column, predicted(F.struct("image.data", "image.height", "image.width", "image.nChannels")))


def _pixels(df: DataFrame, values: str, alias: str) -> DataFrame:
    at = df.select("pano", "dir", F.col("image.width").alias("w"), F.posexplode(values).alias("i", alias))
    return at.select("pano", "dir", (F.col("i") % F.col("w")).cast("int").alias("u"), F.floor(F.col("i") / F.col("w")).cast("int").alias("v"), alias)


def segment(crops: DataFrame, load: Callable[[], Batch], batch_size: int = 1) -> DataFrame:
    """label_px of crops (pano, dir, image): the model returns a class for each pixel."""
    return _pixels(_predict(crops, load, "labels", "int", batch_size), "labels", "class_id")


def estimate_depth(crops: DataFrame, load: Callable[[], Batch], batch_size: int = 1, config: Config = DEFAULT) -> DataFrame:
    """depth_px of crops: the model returns a disparity for each pixel."""
    raw = _predict(crops, load, "disparity", "float", batch_size)
    scaled = normalised_array(F.col("disparity"), config)
    return _pixels(raw.withColumn("depth", scaled), "depth", "depth_norm")


def normalised_array(disparity, config: Config = DEFAULT):
    low, high = F.array_min(disparity), F.array_max(disparity)
    return F.transform(disparity, lambda d: (F.lit(1.0) - (d - low) / (high - low + F.lit(config.disparity_eps))).cast("float"))


def normalise(disparity: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Depth in 0 (near) to 1 from disparity pixels (pano, dir, u, v, disparity), by the
    range of each crop; a constant crop is 1 everywhere."""
    span = disparity.groupBy("pano", "dir").agg(F.min("disparity").alias("low"), F.max("disparity").alias("high"))
    joined = disparity.join(span, ["pano", "dir"])
    return joined.select("pano", "dir", "u", "v", (F.lit(1.0) - (F.col("disparity") - F.col("low")) / (F.col("high") - F.col("low") + F.lit(config.disparity_eps))).alias("depth_norm"))
