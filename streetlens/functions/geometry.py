"""Cameras, the ground plane, the grid and the safety index as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, DIRECTIONS, Config


def focal_length(width: Column, hfov_deg: Column) -> Column:
    return width / 2 / F.tan(F.radians(hfov_deg) / 2)


def focal(config: Config = DEFAULT) -> Column:
    """The focal length of a crop; its centre is half its size."""
    return focal_length(F.lit(float(config.crop_width)), F.lit(config.crop_hfov_deg))


def centre(config: Config = DEFAULT) -> tuple[float, float]:
    return config.crop_width / 2, config.crop_height / 2


def yaw_of(direction: Column) -> Column:
    expr = None
    for _, name, yaw in DIRECTIONS:
        expr = F.when(direction == name, F.lit(yaw)) if expr is None else expr.when(direction == name, F.lit(yaw))
    return expr


def order_of(direction: Column) -> Column:
    expr = None
    for i, name, _ in DIRECTIONS:
        expr = F.when(direction == name, F.lit(i)) if expr is None else expr.when(direction == name, F.lit(i))
    return expr


def direction_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for _, n, _ in DIRECTIONS]), (index + 1).cast("int"))


def ground_distance(v: Column, config: Config = DEFAULT) -> Column:
    """Metres to the ground seen in image row v; null on or over the horizon, and out of range."""
    yn = (v - F.lit(centre(config)[1])) / focal(config)
    z = F.lit(config.cam_height) / yn
    return F.when((yn > config.horizon_eps) & (z > 0) & (z <= config.max_range), z)


def lateral(u: Column, z: Column, config: Config = DEFAULT) -> Column:
    return (u - F.lit(centre(config)[0])) / focal(config) * z


def cell_of(x: Column, z: Column, yaw_deg: Column, origin: tuple[int, int], config: Config = DEFAULT) -> tuple[Column, Column]:
    """Grid column and row of a point x to the right and z ahead, rounded half to even."""
    t = F.radians(yaw_deg)
    s, c = F.sin(t), F.cos(t)
    col = F.lit(float(origin[0])) + (z * s + x * c) / config.grid_res
    row = F.lit(float(origin[1])) + (-z * c + x * s) / config.grid_res
    return F.rint(col).cast("int"), F.rint(row).cast("int")


def on_grid(col: Column, row: Column, width: int, height: int) -> Column:
    return (col >= 0) & (col < width) & (row >= 0) & (row < height)


def stopping_distance(config: Config = DEFAULT) -> Column:
    v = F.lit(config.speed_kmh) / F.lit(3.6)
    return v * F.lit(config.reaction_s) + v * v / (F.lit(2.0) * F.lit(config.friction) * F.lit(config.gravity))


def safety_index(l_vis: Column, a_shadow: Column, config: Config = DEFAULT) -> Column:
    sight = stopping_distance(config) / F.greatest(l_vis, F.lit(config.min_l_vis))
    return sight * (F.lit(1.0) + a_shadow / F.greatest(F.lit(config.disk_area), F.lit(1.0))) * F.lit(1 + config.v_heavy)


def grade(dsi: Column, config: Config = DEFAULT) -> Column:
    return F.when(dsi < config.safe_below, "Safe").when(dsi < config.caution_below, "Caution").otherwise("High-risk")


def edge_weight(distance: Column, config: Config = DEFAULT) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(config.haz_r))


def polar_to_pixel(angle_deg: Column, distance: Column, origin: tuple[int, int], config: Config = DEFAULT) -> tuple[Column, Column]:
    a = F.radians(angle_deg)
    return F.lit(float(origin[0])) + F.sin(a) * distance / config.grid_res, F.lit(float(origin[1])) - F.cos(a) * distance / config.grid_res


def rounded(x: Column, digits: int) -> Column:
    """For records; the working values keep full precision."""
    return F.bround(x, digits)
