"""Rays over the grid: first hits and the cells behind them.

Samples of all rays collapse to a table of the cells that each ray meets, with the first
and last sample in each. It depends on the configuration only, is some 90,000 rows for
the merged grid (2 MB), and is the one table that is broadcast by hint.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config
from streetlens.operators.layout import by_pano
from streetlens.operators.raster import unblocked

#: Rows of a ray table above which it is not hinted for broadcast.
BROADCAST_ROWS = 500_000


def angles(config: Config = DEFAULT, single: bool = False) -> list[float]:
    """Degrees of each ray, 0 ahead and clockwise."""
    if single:
        half, n = config.crop_hfov_deg / 2, int(config.crop_hfov_deg * 2) + 1
        return [-half + config.crop_hfov_deg * i / (n - 1) for i in range(n)]
    return [360 * i / config.n_rays for i in range(config.n_rays)]


def ray_cells(spark: SparkSession, config: Config = DEFAULT, single: bool = False) -> DataFrame:
    """ray, ang, col, row, smin, smax: cells of each ray up to where it leaves the grid."""
    width, height = config.single_grid if single else (config.canvas, config.canvas)
    ox, oy = config.single_origin if single else config.center
    n = len(angles(config, single))
    ang = (F.lit(-config.crop_hfov_deg / 2) + F.col("ray") * config.crop_hfov_deg / (n - 1)) if single else F.col("ray") * F.lit(360.0) / n
    rays = spark.range(n).select(F.col("id").cast("int").alias("ray")).withColumn("ang", ang.cast("double"))
    at = rays.select("ray", "ang", F.explode(F.sequence(F.lit(0), F.lit(config.ray_steps - 1))).alias("s"))
    dist = F.col("s") * F.lit(config.ray_step)
    a = F.radians("ang")
    col = F.rint(F.lit(float(ox)) + F.sin(a) * dist / config.grid_res).cast("int")
    row = F.rint(F.lit(float(oy)) - F.cos(a) * dist / config.grid_res).cast("int")
    inside = (F.col("col") >= 0) & (F.col("col") < width) & (F.col("row") >= 0) & (F.col("row") < height)
    samples = at.withColumn("col", col).withColumn("row", row)
    if single:  # a ray ends at its first sample off the grid
        out = samples.where(~inside).groupBy("ray").agg(F.min("s").alias("end"))
        samples = samples.join(out, "ray", "left").where((F.col("s") < F.col("end")) | F.col("end").isNull())
    else:
        samples = samples.where(inside)
    return samples.groupBy("ray", "ang", "col", "row").agg(F.min("s").alias("smin"), F.max("s").alias("smax"))


@lru_cache(maxsize=8)
def _few(config: Config, single: bool) -> bool:
    return len(angles(config, single)) * config.ray_steps <= BROADCAST_ROWS


def _small(cells: DataFrame, config: Config, single: bool) -> DataFrame:
    return F.broadcast(cells) if _few(config, single) else cells


def distance(sample: Column, config: Config = DEFAULT) -> Column:
    """Metres of a sample; the whole range where there is none."""
    return F.coalesce(sample * F.lit(config.ray_step), F.lit(config.max_range))


def first_hits(occupied: DataFrame, cells: DataFrame, config: Config = DEFAULT, single: bool = False) -> DataFrame:
    """The first sample of each ray on an occupied cell: pano, variant, ray, ang, hit_s.
    Rays without a hit have no row."""
    met = occupied.select("pano", "variant", "col", "row").join(_small(cells, config, single), ["col", "row"])
    return met.groupBy("pano", "variant", "ray", "ang").agg(F.min("smin").alias("hit_s"))


def shadow_blocks(hits: DataFrame, cells: DataFrame, config: Config = DEFAULT, single: bool = False) -> DataFrame:
    """Cells at or behind the first hit of a ray, as words of bits (raster.blocks): pano,
    variant, row, block, bits. Bits are or-ed, which generated code does in a hash table
    before the shuffle, instead of cells being made distinct."""
    words = -(-(config.single_grid[0] if single else config.canvas) // 64)
    marked = cells.select("ray", "smax", (F.col("row") * words + F.expr("col div 64")).cast("int").alias("word"), F.expr("shiftleft(1L, col % 64)").alias("bit"))
    behind = by_pano(hits.select("pano", "variant", "ray", "hit_s")).join(_small(marked, config, single), "ray").where("smax >= hit_s")
    marks = behind.groupBy("pano", "variant", "word").agg(F.bit_or("bit").alias("bits"))
    return marks.select("pano", "variant", F.expr(f"cast(word div {words} as int)").alias("row"), F.expr(f"word % {words}").alias("block"), "bits")


def shadow_cells(hits: DataFrame, cells: DataFrame, config: Config = DEFAULT, single: bool = False) -> DataFrame:
    """Cells at or behind the first hit of a ray, once each: pano, variant, col, row."""
    return unblocked(shadow_blocks(hits, cells, config, single))


def shadow_counts(hits: DataFrame, cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The number of shadow cells of each pano and variant."""
    return shadow_blocks(hits, cells, config).groupBy("pano", "variant").agg(F.sum(F.bit_count("bits")).cast("long").alias("shadow_cells"))
