"""Label and mask algebra over pixels and image columns.

Pixels are aggregated once, to a row for each class in each image column; areas, masks
and profiles follow from these rows, which are some hundred times fewer. Class tables
are as small as the vocabulary of a segmentation model, so Spark may broadcast them by
its own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config

CROP = ["pano", "dir"]


def _number(pixels: DataFrame) -> Column:
    """How many pixels there are; a row stands for n of them where it says so."""
    return (F.sum("n") if "n" in pixels.columns else F.count(F.lit(1))).cast("long")


def class_areas(labels: DataFrame, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pixels of each blocker class in each crop, those of small classes left out."""
    area = labels.groupBy(*CROP, "class_id").agg(_number(labels).alias("area_px"))
    return area.join(flags.where("is_blocker").select("class_id", F.col("name").alias("class_name")), "class_id").where(F.col("area_px") >= config.min_blocker_px).select(*CROP, "class_id", "class_name", "area_px")


def detections(areas: DataFrame) -> DataFrame:
    """One row for each crop with its detections, the largest first, ties by class."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("area_px")).alias("o"), "class_id", "class_name", "area_px")))
    return areas.groupBy(*CROP).agg(F.transform(ordered, lambda d: F.struct(d["class_id"].alias("class_id"), d["class_name"].alias("class_name"), d["area_px"].alias("area_px"))).alias("detections"))


def flag_totals(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """Ground, vehicle, road and sidewalk pixels of each crop; small classes count."""
    kinds = ("ground", "vehicle", "road", "sidewalk")
    by_class = labels.groupBy(*CROP, "class_id").agg(F.count(F.lit(1)).alias("n"))
    return by_class.join(flags, "class_id").groupBy(*CROP).agg(*[F.sum(F.when(F.col(f"is_{k}"), F.col("n")).otherwise(0)).alias(f"{k}_px") for k in kinds])


def under_hood(v: Column, config: Config = DEFAULT) -> Column:
    return v >= config.hood_row


def column_classes(pixels: DataFrame, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pano, dir, u, class_id, n (all pixels), v (the lowest one above the hood, or null)
    and, where pixels have a depth, disp at that pixel; with the class's flags, and
    is_obstacle where pixels have it."""
    seen = ~under_hood(F.col("v"), config)
    extra = [F.max_by(F.lit(1.0) - F.col("depth_norm").cast("double"), F.when(seen, F.col("v"))).alias("disp")] if "depth_norm" in pixels.columns else []
    extra += [F.bool_or("is_obstacle").alias("is_obstacle")] if "is_obstacle" in pixels.columns else []
    by_column = pixels.groupBy(*CROP, "u", "class_id").agg(_number(pixels).alias("n"), F.max(F.when(seen, F.col("v"))).alias("v"), *extra)
    return by_column.join(flags.drop("name"), "class_id")


def with_obstacles(columns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """column_classes with is_obstacle: blocker classes that are large enough in their crop."""
    large = columns.groupBy(*CROP, "class_id").agg(F.sum("n").alias("area_px")).where(F.col("area_px") >= config.min_blocker_px).select(*CROP, "class_id", F.lit(True).alias("large"))
    joined = columns.join(large, [*CROP, "class_id"], "left")
    return joined.withColumn("is_obstacle", F.col("is_blocker") & F.coalesce("large", F.lit(False))).drop("large")


def base_pixels(columns: DataFrame) -> DataFrame:
    """The lowest valid pixel of each image column in the layers occ, other and vehicle:
    pano, dir, layer, u, v (and disp). Ground and the hood are never valid."""
    layers = F.filter(
        F.array(
            F.when(F.col("is_obstacle"), F.lit("occ")), F.when(F.col("is_vehicle"), F.lit("vehicle")),
            F.when(~F.col("is_obstacle") & ~F.col("is_vehicle"), F.lit("other")),
        ),
        lambda x: x.isNotNull(),
    )
    extra = [F.max_by("disp", "v").alias("disp")] if "disp" in columns.columns else []
    valid = columns.where("not is_ground and v is not null").withColumn("layer", F.explode(layers))
    return valid.groupBy(*CROP, "layer", "u").agg(F.max("v").alias("v"), *extra)


def pixel_masks(labels: DataFrame, flags: DataFrame, areas: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The masks of every pixel: obstacle, ground (with hood), valid, vehicle, other and
    occluder source. areas: class_areas, for labels without is_obstacle. Plans that need
    profiles only use column_classes instead."""
    p = labels.join(flags.drop("name"), "class_id")
    if "is_obstacle" not in labels.columns:
        p = p.join(areas.select(*CROP, "class_id", F.lit(True).alias("is_obstacle")), [*CROP, "class_id"], "left")
    ground = F.col("is_ground") | under_hood(F.col("v"), config)
    obstacle = F.coalesce("is_obstacle", F.lit(False))
    return p.select(
        *CROP, "u", "v", "class_id", obstacle.alias("is_obstacle"), ground.alias("is_ground"), (~ground).alias("is_valid"),
        (F.col("is_vehicle") & ~ground).alias("is_vehicle"), (~ground & ~obstacle & ~F.col("is_vehicle")).alias("is_other"), (obstacle & ~ground).alias("is_occluder"),
        "is_road", "is_sidewalk",
    )


def with_masks_or_default(crops: DataFrame, flags_px: DataFrame, depth: DataFrame) -> DataFrame:
    """Pixels of the crops with flags and depth where there are any: a crop without masks
    has none set, one without depth has depth 0."""
    keys = [*CROP, "u", "v"]
    joined = crops.join(flags_px, keys, "left").join(depth, keys, "left")
    return or_default(joined, [c for c in flags_px.columns if c.startswith("is_")])


def or_default(px: DataFrame, flags: list[str]) -> DataFrame:
    """Pixels whose flags and depth_norm are null where a crop has none, with the defaults."""
    return px.select(*CROP, "u", "v", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], F.coalesce("depth_norm", F.lit(0.0).cast("float")).alias("depth_norm"))
