"""Panoramas to directional crops with pinhole cameras."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, DIRECTIONS, Config
from streetlens.functions.geometry import focal_length


def with_directions(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each row once for each direction: dir_idx, dir, yaw_deg."""
    rows = F.array(*[F.struct(F.lit(i).alias("dir_idx"), F.lit(n).alias("dir"), F.lit(y).alias("yaw_deg")) for i, n, y in DIRECTIONS[: config.n_split]])
    return df.select("*", F.explode(rows).alias("__d")).select(*df.columns, "__d.*")


def cameras(panoramas: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Camera records of panoramas (pano, src_image, width, height)."""
    d = with_directions(panoramas, config)
    w, h = F.floor(F.col("width") / config.n_split).cast("int"), F.col("height").cast("int")
    fx = focal_length(w.cast("double"), F.lit(config.crop_hfov_deg))
    cx, cy = w / F.lit(2.0), h / F.lit(2.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return d.select(
        F.col("pano").cast("string").alias("pano"), "src_image", F.array(h, F.col("width").cast("int")).alias("src_hw"), F.array(h, w).alias("out_hw"),
        F.lit(config.crop_hfov_deg).alias("hfov_deg"), F.col("dir").alias("direction"), "yaw_deg", F.array(F.col("dir_idx"), F.lit(config.n_split)).alias("split"),
        F.array(F.array(fx, zero, cx), F.array(zero, fx, cy), F.array(zero, zero, one)).alias("K"),
        fx.alias("fx"), fx.alias("fy"), cx.alias("cx"), cy.alias("cy"),
    )


def crop_pixels(pixels: DataFrame, width: Column, config: Config = DEFAULT) -> DataFrame:
    """Panorama pixels (u, ...) as pixels of crops: columns left of the remainder only."""
    seg = F.floor(width / config.n_split).cast("int")
    index = F.floor(F.col("u") / seg).cast("int")
    inside = pixels.withColumn("dir_idx", index).where(F.col("dir_idx") < config.n_split)
    return inside.withColumn("u", (F.col("u") - F.col("dir_idx") * seg).cast("int"))


def crop_images(images: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Image rows (pano, image) as crops (pano, dir_idx, dir, yaw_deg, image), in rows
    of bytes as the image source has them."""

    @F.pandas_udf("origin string, height int, width int, nChannels int, mode int, data binary")
    def cut(image: pd.DataFrame, index: pd.Series) -> pd.DataFrame:
        import numpy as np

        rows = []
        for (origin, h, w, c, mode, data), i in zip(image[["origin", "height", "width", "nChannels", "mode", "data"]].itertuples(index=False), index, strict=True):
            seg = w // config.n_split
            part = np.frombuffer(data, np.uint8).reshape(h, w, c)[:, i * seg : (i + 1) * seg]
            rows.append((origin, h, seg, c, mode, part.tobytes()))
        return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    return with_directions(images, config).withColumn("image", cut("image", "dir_idx"))
