"""What figures show, as tables: composed grids, overlays, arrows and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, HAZARD_RGB, LAYER_RGB, NO_DATA_RGB, SHADOW_RGB, Config
from streetlens.functions.geometry import polar_to_pixel
from streetlens.operators.raster import blocks, unblocked

#: The shadow among the layers.
SHADOW = "(shadow)"


def composite(layers: DataFrame, shadow: DataFrame | None = None, shadow_rgb: tuple[int, int, int] = SHADOW_RGB) -> DataFrame:
    """The topmost colour of each cell of layers (pano, layer, col, row); cells without any
    are left out and show NO_DATA_RGB. A shadow goes over everything: cells (pano, col,
    row), or words of their bits (pano, row, block, bits). Colours are found for the 64
    cells of a word at a time; a layer without a colour is under all others."""
    cells = blocks(layers.select("pano", "layer", "col", "row"))
    drawn = [*LAYER_RGB]
    if shadow is not None:
        marks = shadow.select("pano", "row", "block", "bits") if "bits" in shadow.columns else blocks(shadow.select("pano", "col", "row"))
        cells = cells.unionByName(marks.withColumn("layer", F.lit(SHADOW)))
        drawn.append((SHADOW, shadow_rgb))
    known = F.col("layer").isin([name for name, _ in drawn])
    bits = [F.bit_or(F.when(F.coalesce(on, F.lit(False)), F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k, on in enumerate([~F.coalesce(known, F.lit(False)), *[F.col("layer") == name for name, _ in drawn]])]
    words = cells.groupBy("pano", "row", "block").agg(*bits)
    colours = [(None, None, None), *[rgb for _, rgb in drawn]]
    shown, over = [], F.lit(0).cast("long")
    for k in reversed(range(len(colours))):
        shown.append(F.struct(F.col(f"b{k}").bitwiseAND(F.bitwise_not(over)).alias("bits"), *[F.lit(x).cast("int").alias(c) for x, c in zip(colours[k], "rgb", strict=True)]))
        over = over.bitwiseOR(F.col(f"b{k}"))
    seen = words.select("pano", "row", "block", F.explode(F.array(*shown)).alias("p")).where("p.bits != 0")
    return unblocked(seen.select("pano", "row", "block", "p.bits", "p.r", "p.g", "p.b")).select("pano", "col", "row", "r", "g", "b")


def hazard_composite(layers: DataFrame, shadow: DataFrame) -> DataFrame:
    return composite(layers, shadow, HAZARD_RGB)


def dense(composed: DataFrame, panos: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every cell of every panorama, for an image."""
    side = F.sequence(F.lit(0), F.lit(config.canvas - 1))
    every = panos.select("pano", F.explode(side).alias("row")).select("pano", "row", F.explode(side).alias("col"))
    grey = [F.coalesce(c, F.lit(x)).alias(c) for c, x in zip("rgb", NO_DATA_RGB, strict=True)]
    return every.join(composed, ["pano", "col", "row"], "left").select("pano", "col", "row", *grey)


def swap_channels(px: DataFrame, first: str = "b", last: str = "r") -> DataFrame:
    """Blue-green-red to red-green-blue and back."""
    return px.withColumns({first: F.col(last), last: F.col(first)})


def overlay(image_px: DataFrame, detected: DataFrame, vehicle_px: DataFrame, colours: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The image (pano, dir, u, v, b, g, r) with detected classes (pano, dir, u, v,
    class_id) and then vehicles blended over it; colours: class_id, b, g, r, a grey where
    there is none. Each channel is cut to 0..255 and to a whole number at the end."""
    keys = ["pano", "dir", "u", "v"]
    tint = tints(detected.join(colours, "class_id", "left"), config).select(*keys, *[f"c{c}" for c in "bgr"])
    joined = image_px.join(tint, keys, "left").join(vehicle_px.select(*keys, F.lit(True).alias("veh")), keys, "left")
    return blended(joined, config)


def tints(colours: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Colours b, g, r as cb, cg, cr, a grey where there is none."""
    grey = {f"c{c}": F.coalesce(c, F.lit(x)) for c, x in zip("bgr", config.default_bgr, strict=True)}
    return colours.withColumns(grey).drop(*"bgr")


def blended(px: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pixels (pano, dir, u, v, b, g, r) with a tint (cb, cg, cr) where there is one, and
    then the colour of vehicles where veh is true."""
    keys = ["pano", "dir", "u", "v"]
    keep = 1 - config.overlay_alpha
    mixed = {}
    for c, vehicle in zip("bgr", config.vehicle_bgr, strict=True):
        x = F.col(c).cast("float")
        x = F.when(F.col(f"c{c}").isNotNull(), (x * F.lit(keep) + F.col(f"c{c}") * F.lit(config.overlay_alpha)).cast("float")).otherwise(x)
        x = F.when(F.col("veh"), (x * F.lit(keep) + F.lit(vehicle * config.overlay_alpha)).cast("float")).otherwise(x)
        mixed[c] = F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")
    return px.select(*keys, *[mixed[c].alias(c) for c in "bgr"])


def colour_map(depth_px: DataFrame, table: DataFrame) -> DataFrame:
    """Depth pixels (depth_norm in 0..1) through a table of 256 colours (level, r, g, b in
    0..1), each channel times 255 without its fraction."""
    level = F.least(F.floor(F.col("depth_norm") * 256), F.lit(255)).cast("int")
    return depth_px.withColumn("level", level).join(table, "level").select("pano", "dir", "u", "v", *[F.floor(F.col(c) * 255).cast("int").alias(c) for c in "rgb"])


def resized_bilinear(image_px: DataFrame, width: int, height: int, to: int = 256) -> DataFrame:
    """An image (pano, dir, u, v, b, g, r) at another size: each pixel is the mean of the
    four around its centre in the image, weighed by nearness, to the nearest whole number.
    Every pixel of the image votes for the pixels that it weighs in."""

    def votes(x: Column, size: int) -> Column:
        scale = size / to
        centre = lambda t: F.least(F.greatest((t + F.lit(0.5)) * F.lit(scale) - F.lit(0.5), F.lit(0.0)), F.lit(size - 1.0))
        first = F.greatest(F.floor((x - F.lit(0.5)) / F.lit(scale) - F.lit(0.5)), F.lit(0)).cast("int")
        last = F.least(F.ceil((x + F.lit(1.5)) / F.lit(scale) - F.lit(0.5)), F.lit(to - 1)).cast("int")
        # at the edges all pixels beyond take the one at the edge
        first, last = F.when(x == 0, F.lit(0)).otherwise(first), F.when(x == size - 1, F.lit(to - 1)).otherwise(last)
        weighed = F.transform(F.sequence(first, last), lambda t: F.struct(t.cast("int").alias("at"), (F.lit(1.0) - F.abs(centre(t) - x)).alias("w")))
        return F.filter(weighed, lambda p: p["w"] > 0)

    at = image_px.select("pano", "dir", "v", *"bgr", F.explode(votes(F.col("u"), width)).alias("x")).select("pano", "dir", *"bgr", "x", F.explode(votes(F.col("v"), height)).alias("y"))
    weight = F.col("x.w") * F.col("y.w")
    mean = at.groupBy("pano", "dir", F.col("x.at").alias("u"), F.col("y.at").alias("v")).agg(*[F.sum(F.col(c) * weight).alias(c) for c in "bgr"])
    return mean.select("pano", "dir", "u", "v", *[F.floor(F.round(c, 6) + F.lit(0.5)).cast("int").alias(c) for c in "bgr"])


def resized(image_px: DataFrame, width: int, height: int, to: int = 256) -> DataFrame:
    """Nearest pixels of an image at another size (thumbnails)."""
    sx, sy = width / to, height / to
    lo = lambda x, s: F.ceil(x / F.lit(s) - F.lit(0.5))  # noqa: E731  the first target whose source is x
    us = F.sequence(F.greatest(lo(F.col("u"), sx), F.lit(0)).cast("int"), (lo(F.col("u") + 1, sx) - 1).cast("int"))
    vs = F.sequence(F.greatest(lo(F.col("v"), sy), F.lit(0)).cast("int"), (lo(F.col("v") + 1, sy) - 1).cast("int"))
    rest = [c for c in image_px.columns if c not in ("u", "v")]
    wide = image_px.where((lo(F.col("u") + 1, sx) - 1 >= F.greatest(lo(F.col("u"), sx), F.lit(0))) & (lo(F.col("v") + 1, sy) - 1 >= F.greatest(lo(F.col("v"), sy), F.lit(0))))
    return wide.select(*rest, F.explode(us).alias("u"), vs.alias("__vs")).select(*rest, "u", F.explode("__vs").alias("v")).where((F.col("u") < to) & (F.col("v") < to))


def arrows(ring_rows: DataFrame, config: Config = DEFAULT, count: int = 24) -> DataFrame:
    """Every few rays from the centre to its hit: pano, variant, ray, x0, y0, x1, y1."""
    every = max(1, config.n_rays // count)
    at = ring_rows.select("pano", "variant", F.posexplode("ring").alias("ray", "dist")).where(F.col("ray") % every == 0)
    x, y = polar_to_pixel(F.col("ray") * F.lit(360 / config.n_rays), F.col("dist"), config.center, config)
    return at.select("pano", "variant", "ray", F.lit(float(config.center[0])).alias("x0"), F.lit(float(config.center[1])).alias("y0"), x.alias("x1"), y.alias("y1"))


def markers(edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Emergence edges as marks: pano, variant, x, y, size."""
    x, y = polar_to_pixel(F.col("ang"), F.col("dist"), config.center, config)
    return edges.select("pano", "variant", x.alias("x"), y.alias("y"), (F.lit(15.0) + F.lit(90.0) * F.col("weight")).alias("size"))
