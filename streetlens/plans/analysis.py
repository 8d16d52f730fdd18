"""From pixels to safety records, for any number of panoramas.

Pixels are written once as a stage table, or come as runs of such a table, which the base
pixels, the calibration, vehicles as connected components and surfaces read, each of them
a few classes and columns. Base pixels are written once as well. Of what follows, small tables that several branches read are settled
by checkpoints when the plan is made; all else is lazy.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config
from streetlens.operators import calibrate, components, footprint, masks, metrics, profile, raycast
from streetlens.operators import runs as runs_
from streetlens.operators import surfaces as surfaces_
from streetlens.operators.layout import by_pano
from streetlens.operators.runs import Runs
from streetlens.sources.session import settled, staged


@dataclasses.dataclass(frozen=True)
class Scene:
    """The tables that later steps share."""

    present: DataFrame  # pano, dir: crops there are
    calibration: DataFrame  # pano, dir, n, a, b, r2, source
    cells: DataFrame  # pano, layer, col, row
    config: Config


def road_pixels(pixels: DataFrame | Runs, flags: DataFrame) -> DataFrame:
    return pixels_of(pixels, flags.where("is_road"))


def vehicle_pixels(labels: DataFrame | Runs, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Vehicle pixels that are not ground and not under the hood; of runs, as runs."""
    if isinstance(labels, Runs):
        above = labels.rows(flags.where("is_vehicle and not is_ground")).where(~masks.under_hood(F.col("top"), config))
        return above.withColumn("bottom", F.least(F.col("bottom"), F.lit(config.hood_row - 1)))
    return pixels_of(labels, flags.where("is_vehicle and not is_ground")).where(~masks.under_hood(F.col("v"), config))


def occluder_profiles(base: DataFrame, calibration: DataFrame, side: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Profiles of the layer occ: by depth where the calibration is accepted, elsewhere by
    the ground plane with vehicles to the side as a cap."""
    occ = base.where("layer = 'occ'")
    by_depth = calibration.where("source = 'depth'")
    depth = profile.depth_profile(occ, by_depth, config)
    plane = profile.ground_profile(occ.join(by_depth.select("pano", "dir"), ["pano", "dir"], "left_anti"), config)
    return depth.unionByName(profile.capped(plane, profile.ground_profile(side, config)))


def base_pixels(pixels: DataFrame | Runs, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """masks.base_pixels of the image columns that profiles take, as a stage table."""
    if isinstance(pixels, Runs):
        columns = masks.column_classes(runs_.with_obstacles(pixels, flags, config).lowest(config), flags, config)
    else:
        columns = masks.with_obstacles(settled(masks.column_classes(pixels, flags, config)), config)
    return staged(masks.base_pixels(columns.where(F.col("u") % config.subsample == 0)))


def pixels_of(pixels: DataFrame | Runs, classes: DataFrame) -> DataFrame:
    """The pixels of some classes."""
    return pixels.pixels(classes) if isinstance(pixels, Runs) else pixels.join(classes.select("class_id"), "class_id", "left_semi")  # a filter of few classes reaches the scan


def scene(pixels: DataFrame | Runs, flags: DataFrame, present: DataFrame | None = None, config: Config = DEFAULT, *, surfaces: bool = True) -> Scene:
    """Everything up to the merged layers, from pixels (pano, dir, u, v, class_id,
    depth_norm) or runs. surfaces: road and sidewalk as well, which figures show only."""
    if not isinstance(pixels, Runs):
        if "depth_norm" not in pixels.columns:
            pixels = pixels.withColumn("depth_norm", F.lit(0.0).cast("float"))
        pixels = staged(pixels)
    if present is None:
        present = (pixels.crops if isinstance(pixels, Runs) else pixels).select("pano", "dir").distinct()
    base = base_pixels(pixels, flags, config)
    fitted = settled(calibrate.calibrate(road_pixels(pixels, flags), config))
    calibration = present.join(fitted, ["pano", "dir"], "left").withColumn("source", F.coalesce("source", F.lit("ipm")))
    vehicles = settled(components.vehicle_base(vehicle_pixels(pixels, flags, config), config))
    side = vehicles.where("layer = 'veh_side'")
    walls = footprint.footprint(occluder_profiles(base, fitted, side, config), config)
    cars = footprint.footprint(profile.ground_profile(vehicles, config), config)
    others = footprint.footprint(profile.ground_profile(base.where("layer = 'other'"), config), config, connect=False, grow=False)
    cells = walls.unionByName(cars).unionByName(others)
    if surfaces and config.show_road and isinstance(pixels, Runs):
        cells = cells.unionByName(surfaces_.ground_surface(pixels, flags, config))
    elif surfaces and config.show_road:
        layer = F.explode(F.filter(F.array(F.when(F.col("is_road"), F.lit("road")), F.when(F.col("is_sidewalk"), F.lit("sidewalk"))), lambda x: x.isNotNull()))
        ground = pixels_of(pixels, flags.where("is_road or is_sidewalk")).join(flags.where("is_road or is_sidewalk").select("class_id", "is_road", "is_sidewalk"), "class_id").withColumn("layer", layer)
        cells = cells.unionByName(footprint.ground_surface(ground, config))
    return Scene(present, calibration, cells, config)


def occupancy(cells: DataFrame) -> DataFrame:
    """Cells of the two variants: structures (occ), and with vehicles to the side (veh)."""
    variants = F.when(F.col("layer") == "occ", F.array(F.lit("occ"), F.lit("veh"))).when(F.col("layer") == "veh_side", F.array(F.lit("veh")))
    return by_pano(cells.select("pano", F.explode(variants).alias("variant"), "col", "row")).distinct()


def variants_of(panos: DataFrame) -> DataFrame:
    return panos.select("pano").distinct().withColumn("variant", F.explode(F.array(F.lit("occ"), F.lit("veh"))))


def measured(found: Scene) -> DataFrame:
    config = found.config
    rays = settled(raycast.ray_cells(found.cells.sparkSession, config))
    hits = settled(raycast.first_hits(occupancy(found.cells), rays, config))
    shadow = raycast.shadow_counts(hits, rays, config)
    return metrics.measures(metrics.rings(hits, variants_of(found.present), config), shadow, config)


def records(pixels: DataFrame | Runs, flags: DataFrame, present: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The safety record of every panorama that has a direction."""
    found = scene(pixels, flags, present, config, surfaces=False)
    return metrics.record(measured(found), found.calibration.select("pano", "dir", "source"), config)


def comparison(pixels: DataFrame, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Structures ahead in the grid of one view, by both methods: pano, method (ipm or
    depth), col, row, n, r2. Any fit with a positive slope counts, however good; panoramas
    without one have rows of the first method only."""
    front = staged(pixels.where("dir = 'front'"))
    columns = settled(masks.column_classes(front, flags, config))
    base = settled(masks.base_pixels(masks.with_obstacles(columns, config)).where("layer = 'occ'"))
    fitted = settled(calibrate.calibrate(road_pixels(front, flags), config.replace(depth_r2_min=float("-inf"))).where("source = 'depth'"))
    plane = footprint.footprint(profile.ground_profile(base, config), config, single=True).withColumn("method", F.lit("ipm"))
    depth = footprint.footprint(profile.depth_profile(base, fitted, config), config, single=True).withColumn("method", F.lit("depth"))
    both = plane.unionByName(depth)
    return both.join(fitted.select("pano", "n", "r2"), "pano", "left").select("pano", "method", "col", "row", "n", "r2")
