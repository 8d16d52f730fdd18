"""Relative depth to metres, by the road."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config
from streetlens.functions.geometry import centre, focal


def calibrate(road_px: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Least squares of inverse distance by disparity over road pixels (pano, dir, v,
    depth_norm), one pass: pano, dir, n, a, b, r2, source.

    source is ``depth`` if there are enough pixels, the slope is positive and the fit is
    good enough; a slope that is undefined (constant depth) is no fit."""
    used = road_px.where((F.col("v") >= int(config.crop_height * config.calibration_v_frac)) & (F.col("v") > centre(config)[1] + config.calibration_horizon_px))
    x = F.lit(1.0) - F.col("depth_norm").cast("double")
    y = (F.col("v") - F.lit(centre(config)[1])) / (F.lit(config.cam_height) * focal(config))
    fit = used.select("pano", "dir", x.alias("x"), y.alias("y")).groupBy("pano", "dir").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy")
    )
    r2 = F.lit(1.0) - (F.col("syy") - F.col("a") * F.col("sxy")) / (F.col("syy") + F.lit(1e-9))
    accepted = (F.col("n") >= config.calibration_min_px) & (F.col("a") > 0) & (r2 >= config.depth_r2_min) & F.lit(config.occluder_from_depth)
    return fit.select("pano", "dir", "n", "a", "b", r2.alias("r2"), F.when(accepted, F.lit("depth")).otherwise(F.lit("ipm")).alias("source"))
