"""Rings, shadows and composites where cells are many."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from streetlens.operators import metrics, raster, raycast, render


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_ring_is_made_once(spark):
    hits = spark.createDataFrame([(1, "occ", r, r * 0.5, r % 170) for r in (0, 1, 5, 700, 719)], "pano int, variant string, ray int, ang double, hit_s int")
    ring = metrics.rings(hits, spark.createDataFrame([(1, "occ"), (2, "occ")], "pano int, variant string"))
    got = {r.pano: r.ring for r in ring.collect()}
    want = [60.0] * 720
    for r in (0, 1, 5, 700, 719):
        want[r] = r % 170 * 0.35
    assert np.allclose(got[1], want) and got[2] == [60.0] * 720
    sight = ring.select("pano", metrics.sight_ahead(F.col("ring")).alias("l"))
    assert {r.pano: r.l for r in sight.collect()} == {1: 60.0, 2: 60.0}
    assert "map_from_entries" not in plan_of(sight)  # no search of all hits for each ray


def test_shadows_are_words(spark):
    rays = raycast.ray_cells(spark)
    occupied = spark.createDataFrame([(1, "occ", 120, 100), (1, "occ", 63, 64), (1, "occ", 64, 190)], "pano int, variant string, col int, row int")
    hits = raycast.first_hits(occupied, rays)
    cells = raycast.shadow_cells(hits, rays)
    want = hits.select("pano", "variant", "ray", "hit_s").join(rays, "ray").where("smax >= hit_s").select("pano", "variant", "col", "row").distinct()
    assert cells.exceptAll(want).count() == 0 and want.exceptAll(cells).count() == 0
    assert "bit_or" in plan_of(cells)  # cells are not made distinct one by one
    assert raster.unblocked(raster.blocks(cells)).exceptAll(cells).count() == 0


def test_composites_take_words(spark):
    layers = spark.createDataFrame([(1, "road", 3, 3), (1, "occ", 3, 3), (1, "new", 3, 3), (1, "new", 70, 3), (1, "sidewalk", 64, 4)], "pano int, layer string, col int, row int")
    shadow = spark.createDataFrame([(1, 64, 4), (1, 127, 4)], "pano int, col int, row int")
    by_cells, by_words = (render.composite(layers, s) for s in (shadow, raster.blocks(shadow)))
    want = {(3, 3, 220, 80, 80), (70, 3, None, None, None), (64, 4, 255, 200, 0), (127, 4, 255, 200, 0)}
    assert set(map(tuple, by_cells.drop("pano").collect())) == want
    assert set(map(tuple, by_words.drop("pano").collect())) == want
