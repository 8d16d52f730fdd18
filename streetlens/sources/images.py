"""Panoramas and crops as image rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.config import DIRECTIONS

_DIRS = "|".join(n for _, n, _ in DIRECTIONS)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def pano_of(crop_stem: Column) -> Column:
    """A crop's panorama: its stem without the direction, wherever that occurs."""
    return F.regexp_replace(crop_stem, f"_({_DIRS})$", "")


def direction_of(crop_stem: Column) -> Column:
    return F.nullif(F.regexp_extract(crop_stem, f"_({_DIRS})$", 1), F.lit(""))


def read_panoramas(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """pano, src_image, image of a folder, its subfolders left out; what is no image is
    dropped. Image bytes are blue, green, red."""
    rows = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select(stem(F.col("image.origin")).alias("pano"), F.regexp_extract("image.origin", "[^/]*$", 0).alias("src_image"), "image").where("image.height > 0")


def read_crops(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """pano, dir, image of crops named by panorama and direction; other names are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    named = rows.withColumn("stem", stem(F.col("image.origin"))).withColumn("dir", direction_of(F.col("stem")))
    return named.where("dir is not null and image.height > 0").select(pano_of(F.col("stem")).alias("pano"), "dir", "image")


def panorama_names(crops: DataFrame) -> DataFrame:
    """Panoramas that have a crop ahead, once each."""
    return crops.where("dir = 'front'").select("pano").distinct()


def pixels(images: DataFrame) -> DataFrame:
    """The pixels of image rows (pano, dir, image): pano, dir, u, v, b, g, r."""
    at = images.select("pano", "dir", "image.width", "image.nChannels", "image.data", F.explode(F.sequence(F.lit(0), F.expr("image.width * image.height - 1"))).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * F.col("nChannels") + k, F.lit(1))), 16, 10).cast("int")
    return at.select("pano", "dir", (F.col("i") % F.col("width")).cast("int").alias("u"), F.floor(F.col("i") / F.col("width")).cast("int").alias("v"), byte(1).alias("b"), byte(2).alias("g"), byte(3).alias("r"))


def thumbnails(crops: DataFrame, overlays: DataFrame) -> DataFrame:
    """The overlay of each crop (pano, dir, image), or else the crop itself."""
    drawn = overlays.select("pano", "dir", F.col("image").alias("drawn"))
    return crops.join(drawn, ["pano", "dir"], "left").select("pano", "dir", F.coalesce("drawn", "image").alias("image"))
