"""Sight ahead, emergence edges and the safety record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, Config
from streetlens.functions.geometry import edge_weight, grade, order_of, rounded, safety_index, stopping_distance
from streetlens.operators.layout import by_pano
from streetlens.operators.raycast import angles, distance


def rings(hits: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row for each key (pano, variant) with ring: the distance of every ray in order,
    the whole range where it hits nothing. Keys without any hit have such a row as well."""
    found = by_pano(hits).groupBy("pano", "variant").agg(F.array_sort(F.collect_list(F.struct("ray", "hit_s"))).alias("at"))
    full = by_pano(keys.select("pano", "variant").distinct()).join(found, ["pano", "variant"], "left")
    none = lambda n: F.array_repeat(F.lit(config.max_range), n.cast("int"))
    # each hit with the rays without one before it, so that a ring takes one pass over its hits
    before = lambda i: F.when(i > 0, F.col("at")[i - 1]["ray"]).otherwise(F.lit(-1))
    parts = F.transform("at", lambda x, i: F.concat(none(x["ray"] - before(i) - 1), F.array(distance(x["hit_s"], config))))
    ring = F.concat(F.flatten(parts), none(F.lit(config.n_rays - 1) - F.element_at("at", -1)["ray"]))
    return full.select("pano", "variant", F.coalesce(ring, none(F.lit(config.n_rays))).alias("ring"))


def sight_ahead(ring: Column, config: Config = DEFAULT) -> Column:
    """The median distance of the rays in the cone ahead."""
    ahead = [i for i, a in enumerate(angles(config)) if a % 360 <= config.front_cone_deg or a % 360 >= 360 - config.front_cone_deg]
    # the ring is no part of the function: Spark would make it again for each ray
    ordered = F.array_sort(F.filter(ring, lambda x, i: i.isin(ahead)))
    half = len(ahead) // 2
    if not ahead:
        return F.lit(config.max_range)
    return F.element_at(ordered, half + 1) if len(ahead) % 2 else (F.element_at(ordered, half) + F.element_at(ordered, half + 1)) / 2


def emergence(ring: Column, config: Config = DEFAULT, wrap: bool = True) -> Column:
    """Edges where the distance jumps between neighbouring rays, at the nearer one:
    an array of (ang, dist, weight), the last ray next to the first if wrapped."""
    n = config.n_rays
    pairs = F.sequence(F.lit(0), F.lit(n - 1 if wrap else n - 2))
    step = 360 / n

    def edge(i: Column) -> Column:
        d0, d1 = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % n + 1)
        dist = F.least(d0, d1)
        ang = F.when(d0 <= d1, i).otherwise((i + 1) % n) * F.lit(step)
        return F.struct(F.abs(d1 - d0).alias("gap"), ang.alias("ang"), dist.alias("dist"), edge_weight(dist, config).alias("weight"))

    kept = F.filter(F.transform(pairs, edge), lambda e: (e["gap"] >= config.haz_gap) & (e["dist"] < config.max_range) & (e["weight"] > 0))
    return F.transform(kept, lambda e: F.struct(e["ang"].alias("ang"), e["dist"].alias("dist"), e["weight"].alias("weight")))


def emergence_edges(ring_rows: DataFrame, config: Config = DEFAULT, wrap: bool = True) -> DataFrame:
    """pano, variant, ang, dist, weight."""
    return ring_rows.select("pano", "variant", F.explode(emergence(F.col("ring"), config, wrap)).alias("e")).select("pano", "variant", "e.*")


def measures(ring_rows: DataFrame, shadow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Full-precision measures of each pano and variant."""
    edges = emergence(F.col("ring"), config)
    joined = ring_rows.join(shadow, ["pano", "variant"], "left").withColumn("edges", edges)
    area = F.coalesce("shadow_cells", F.lit(0)) * F.lit(config.grid_res**2)
    return (
        joined.select("pano", "variant", sight_ahead(F.col("ring"), config).alias("l_vis"), area.alias("a_shadow"),
            F.aggregate("edges", F.lit(0.0), lambda a, e: a + e["weight"]).alias("h_leak"), F.size("edges").cast("long").alias("n_edges"))
        .withColumn("dsi", safety_index(F.col("l_vis"), F.col("a_shadow"), config)).withColumn("grade", grade(F.col("dsi"), config))
    )


def record(measured: DataFrame, present: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The safety record of each panorama, rounded; present: pano, dir, source."""
    last = "veh" if config.include_vehicles else "occ"
    per = measured.groupBy("pano").agg(*[F.max(F.when(F.col("variant") == v, F.struct("l_vis", "a_shadow", "dsi", "grade", "h_leak", "n_edges"))).alias(v) for v in ("occ", "veh")])
    about = present.groupBy("pano").agg(F.array_sort(F.collect_list(F.struct(order_of(F.col("dir")).alias("o"), "dir", "source"))).alias("d"))
    veh = [
        rounded(F.col("veh.l_vis"), 2).alias("l_vis_veh_m"), rounded(F.col("veh.a_shadow"), 2).alias("a_shadow_veh_m2"),
        rounded(F.col("veh.dsi"), 4).alias("dsi_veh"), F.col("veh.grade").alias("grade_veh"),
    ] if config.include_vehicles else []
    return about.join(per, "pano").select(
        "pano", F.transform("d", lambda x: x["dir"]).alias("dirs_present"), F.map_from_entries(F.transform("d", lambda x: F.struct(x["dir"], x["source"]))).alias("occ_source"),
        rounded(F.col("occ.l_vis"), 2).alias("l_vis_m"), rounded(stopping_distance(config), 2).alias("d_stopping_m"), rounded(F.col("occ.a_shadow"), 2).alias("a_shadow_m2"),
        F.round(F.lit(config.disk_area), 1).alias("a_total_m2"), F.lit(config.v_heavy).alias("v_heavy"), rounded(F.col("occ.dsi"), 4).alias("dsi_refined"), F.col("occ.grade").alias("grade"),
        F.lit(config.include_vehicles).alias("include_vehicles"), *veh,
        rounded(F.col(f"{last}.h_leak"), 3).alias("h_leak"), F.col(f"{last}.n_edges").alias("hazard_edges"), F.lit(config.haz_r).alias("haz_r"),
    )
