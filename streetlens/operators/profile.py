"""Distance profiles: the distance of a layer's base in every second image column.

Sparse: a column without a distance has no row. i numbers the columns; z is float32, as
its median and the test of a jump between columns are defined on float32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config
from streetlens.functions.geometry import ground_distance

LAYER = ["pano", "dir", "layer"]


def ground_profile(base: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """From base pixels (pano, dir, layer, u, v), by the ground plane: z in double."""
    at = base.where(F.col("u") % config.subsample == 0).withColumn("z", ground_distance(F.col("v"), config)).where("z is not null")
    return at.select(*LAYER, (F.col("u") / config.subsample).cast("int").alias("i"), "u", "z")


def depth_profile(base: DataFrame, calibration: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """From base pixels with disp, by calibrated depth (pano, dir, a, b): z in double."""
    z = F.lit(1.0) / F.greatest(F.col("a") * F.col("disp") + F.col("b"), F.lit(config.min_inverse_depth))
    at = base.where(F.col("u") % config.subsample == 0).join(calibration.select("pano", "dir", "a", "b"), ["pano", "dir"]).withColumn("z", z)
    return at.where((F.col("z") > 0) & (F.col("z") <= config.max_range)).select(*LAYER, (F.col("u") / config.subsample).cast("int").alias("i"), "u", "z")


def capped(profile: DataFrame, cap: DataFrame) -> DataFrame:
    """A profile whose distances are no longer than those of the cap in the same column."""
    nearer = cap.select("pano", "dir", "u", F.col("z").alias("z_cap"))
    return profile.join(nearer, ["pano", "dir", "u"], "left").select(*LAYER, "i", "u", F.least("z", "z_cap").alias("z"))


def smoothed(profile: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The median of the distances within two columns to either side, of those there are."""
    half = config.smooth_window // 2
    z = profile.withColumn("z", F.col("z").cast("float"))
    near = Window.partitionBy(*LAYER).orderBy("i").rangeBetween(-half, half)
    return z.withColumn("z", F.percentile("z", F.lit(0.5)).over(near).cast("float"))
