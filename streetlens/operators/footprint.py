"""Profiles and ground pixels to cells of the grid seen from above."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config
from streetlens.functions.geometry import cell_of, ground_distance, lateral, on_grid, yaw_of
from streetlens.operators.layout import by_pano
from streetlens.operators.profile import LAYER, smoothed
from streetlens.operators.raster import close, dilate, line_points


def _grid(config: Config, single: bool) -> tuple[tuple[int, int], int, int]:
    if single:
        return config.single_origin, *config.single_grid
    return config.center, config.canvas, config.canvas


def projected(profile: DataFrame, config: Config = DEFAULT, single: bool = False) -> DataFrame:
    """The profile with the cell of each point; points off the grid are left out.
    single: the view ahead only, in the grid of one view."""
    origin, width, height = _grid(config, single)
    z = F.col("z").cast("double")
    yaw = F.lit(0.0) if single else yaw_of(F.col("dir"))
    col, row = cell_of(lateral(F.col("u"), z, config), z, yaw, origin, config)
    return profile.withColumn("col", col).withColumn("row", row).where(on_grid(F.col("col"), F.col("row"), width, height))


def linked(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Points with the cell of the point in the column before (from_col, from_row), where
    there is one and the distance does not jump. Columns that are missing, or whose point
    is off the grid, break the link: the number before is another one then."""
    before = F.lag(F.struct("i", "col", "row", "z")).over(Window.partitionBy(*LAYER).orderBy("i"))
    joins = (F.col("i") - F.col("p.i") == 1) & (F.abs(F.col("z") - F.col("p.z")) < F.lit(config.connect_thresh).cast("float"))
    at = points.withColumn("p", before)
    return at.withColumn("from_col", F.when(joins, F.col("p.col"))).withColumn("from_row", F.when(joins, F.col("p.row"))).drop("p")


def _drawn(points: DataFrame, keys: list[str]) -> DataFrame:
    line = line_points(F.coalesce("from_col", "col"), F.coalesce("from_row", "row"), F.col("col"), F.col("row"))
    return points.select(*keys, F.explode(line).alias("c")).select(*keys, "c.col", "c.row").distinct()


def footprint(profile: DataFrame, config: Config = DEFAULT, *, connect: bool = True, grow: bool = True, single: bool = False) -> DataFrame:
    """Cells (pano, layer, col, row) of a profile: smoothed, projected, joined by lines
    and grown by a cell. Directions meet in one grid."""
    _, width, height = _grid(config, single)
    points = projected(smoothed(by_pano(profile), config), config, single)
    if connect:
        cells = _drawn(linked(points, config), ["pano", "layer"])
    else:
        cells = points.select("pano", "layer", "col", "row").distinct()
    return dilate(cells, width, height) if grow else cells


def ground_points(mask_px: DataFrame, config: Config = DEFAULT, single: bool = False) -> DataFrame:
    """Every second pixel of a ground mask (pano, dir, layer, u, v) in each second image
    column, as a point; from_col and from_row where it goes on from the pixel before.

    Pixels are numbered before any is rejected, so that a rejected one breaks the line."""
    origin, width, height = _grid(config, single)
    column = Window.partitionBy(*LAYER, "u").orderBy("v")
    ranked = mask_px.where(F.col("u") % config.subsample == 0).select(*LAYER, "u", "v").distinct().withColumn("k", F.row_number().over(column) - 1)
    sampled = ranked.where(F.col("k") % config.subsample == 0).withColumn("k", F.col("k") / config.subsample)
    z = ground_distance(F.col("v"), config)
    at = sampled.withColumn("z", z).where("z is not null")
    yaw = F.lit(0.0) if single else yaw_of(F.col("dir"))
    col, row = cell_of(lateral(F.col("u"), F.col("z"), config), F.col("z"), yaw, origin, config)
    points = at.withColumn("col", col).withColumn("row", row).where(on_grid(F.col("col"), F.col("row"), width, height))
    before = F.lag(F.struct("k", "v", "col", "row")).over(column)
    joins = (F.col("k") - F.col("p.k") == 1) & (F.col("v") - F.col("p.v") <= 2 * config.subsample)
    return points.withColumn("p", before).withColumn("from_col", F.when(joins, F.col("p.col"))).withColumn("from_row", F.when(joins, F.col("p.row"))).drop("p")


def ground_surface(mask_px: DataFrame, config: Config = DEFAULT, *, fill: bool = True, single: bool = False) -> DataFrame:
    """Cells of a ground mask, joined along image columns and closed. A column's cells are
    closed with those of its direction, before directions meet."""
    _, width, height = _grid(config, single)
    cells = _drawn(ground_points(mask_px, config, single), LAYER)
    return (close(cells, width, height) if fill else cells).select("pano", "layer", "col", "row").distinct()
