"""Operators against imperative models and scenes with known results."""

from __future__ import annotations

import math

import model
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streetlens.config import DEFAULT
from streetlens.functions import geometry, vocabulary
from streetlens.operators import calibrate, components, crop, footprint, infer, masks, metrics, profile, raster, raycast, render, sampling
from streetlens.plans import analysis
from streetlens.sources import adapters

YAWS = {"left": -90, "front": 0, "right": 90, "back": 180}


def random_mask(seed, n=60, low=120):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(6):
        u, v, w, h = int(rng.integers(0, 230)), int(rng.integers(low, 180)), int(rng.integers(2, n)), int(rng.integers(2, 30))
        out |= {(x, y) for x in range(u, min(256, u + w)) for y in range(v, min(192, v + h))}
    return out


def px(spark, mask, pano=1, direction="front", layer="occ"):
    return spark.createDataFrame([(pano, direction, layer, u, v) for u, v in sorted(mask)], "pano int, dir string, layer string, u int, v int")


def cells_of(df):
    return {(r.col, r.row) for r in df.select("col", "row").collect()}


def base(df):
    return df.groupBy("pano", "dir", "layer", "u").agg(F.max("v").alias("v"))


@pytest.mark.parametrize("direction", YAWS)
def test_footprint(spark, direction):
    mask, cap = random_mask(1), random_mask(2)
    plane = profile.ground_profile(base(px(spark, mask, direction=direction)))
    assert cells_of(footprint.footprint(plane)) == model.footprint(mask, YAWS[direction])
    capped = profile.capped(plane, profile.ground_profile(base(px(spark, cap, direction=direction))))
    assert cells_of(footprint.footprint(capped, connect=False, grow=False)) == model.footprint(mask, YAWS[direction], cap, connect=False, dilate=False)
    assert cells_of(footprint.footprint(capped)) == model.footprint(mask, YAWS[direction], cap)


@pytest.mark.parametrize("direction", ["front", "right"])
def test_ground_surface(spark, direction):
    mask = random_mask(3) - {(u, 150) for u in range(0, 256, 4)}
    assert cells_of(footprint.ground_surface(px(spark, mask, direction=direction))) == model.surface(mask, YAWS[direction])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-30, 30)] * 4), min_size=1, max_size=30))
def test_lines(spark, ends):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, a int, b int, c int, d int")
    for r in df.select("i", raster.line_points(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p")).collect():
        a, b, c, d = ends[r.i]
        assert {(p.col, p.row) for p in r.p} == set(model.line((a, b), (c, d))) or a == c  # a vertical line may start at either end
        assert {(p.col, p.row) for p in r.p} >= {(a, b), (c, d)} and len(r.p) == max(abs(a - c), abs(b - d)) + 1


def test_close(spark):
    rng = np.random.default_rng(5)
    cells = {(int(x), int(y)) for x, y in rng.integers(0, 12, (40, 2))}
    df = spark.createDataFrame([(1, "x", c, r) for c, r in cells], "pano int, layer string, col int, row int")
    assert cells_of(raster.close(df, 12, 12)) == model.closed(cells, 12)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    mask = {(int(u), int(v)) for u, v in rng.integers(0, 24, (180, 2))}
    runs = components.vertical_runs(px(spark, mask))
    got = {}
    for r in components.components(runs).collect():
        got.setdefault(r.comp, set()).update((r.u, v) for v in range(r.top, r.bottom + 1))
    assert {frozenset(c) for c in got.values()} == model.flood(mask)


def test_vehicles_split_by_angle(spark):
    ahead = {(u, v) for u in range(120, 130) for v in range(150, 160)}
    aside = {(u, v) for u in range(10, 20) for v in range(150, 160)}
    small = {(u, v) for u in range(60, 67) for v in range(150, 157)}  # 49 pixels
    enough = {(u, v) for u in range(200, 210) for v in range(150, 155)}  # 50 pixels
    df = px(spark, ahead | aside | small | enough).drop("layer")
    got = {(r.u, r.layer) for r in components.vehicle_base(df).collect()}
    assert {layer for u, layer in got if 120 <= u < 130} == {"veh_center"}
    assert {layer for u, layer in got if u < 20 or u >= 200} == {"veh_side"} and not any(60 <= u < 67 for u, _ in got)
    left = {r.layer for r in components.vehicle_base(df.withColumn("dir", F.lit("left"))).collect()}
    assert left == {"veh_side"}


def occupied(spark, cells, pano=1):
    return spark.createDataFrame([(pano, "occ", c, r) for c, r in cells], "pano int, variant string, col int, row int")


def rings(spark, hits, pano=1):
    return metrics.rings(hits, spark.createDataFrame([(pano, "occ")], "pano int, variant string"))


@pytest.mark.parametrize("seed", range(3))
def test_rays(spark, seed):
    rng = np.random.default_rng(seed)
    cells = model.grow({(int(c), int(r)) for c, r in rng.integers(60, 180, (25, 2))})
    hits = raycast.first_hits(occupied(spark, cells), raycast.ray_cells(spark))
    ring = rings(spark, hits).first().ring
    want, shadow = model.rays(cells)
    assert np.allclose(ring, want, atol=1e-9)
    assert cells_of(raycast.shadow_cells(hits, raycast.ray_cells(spark))) == shadow
    assert raycast.shadow_counts(hits, raycast.ray_cells(spark)).first().shadow_cells == len(shadow)
    got = [(r.ang, r.dist, r.weight) for r in metrics.emergence_edges(rings(spark, hits)).collect()]
    assert np.allclose(sorted(got), sorted(model.edges(want)), atol=1e-9)
    row = rings(spark, hits).select(metrics.sight_ahead(F.col("ring")).alias("l")).first()
    assert abs(row.l - float(np.median([d for i, d in enumerate(want) if i * 0.5 <= 10 or i * 0.5 >= 350]))) < 1e-9


def test_more_obstacles_never_show_more(spark):
    rays = raycast.ray_cells(spark)
    some = {(100, 90), (130, 140), (120, 60)}
    more = some | {(120, 80), (90, 120)}
    a, b = (raycast.shadow_counts(raycast.first_hits(occupied(spark, c), rays), rays).first().shadow_cells for c in (some, more))
    assert b >= a
    ra, rb = (rings(spark, raycast.first_hits(occupied(spark, c), rays)).first().ring for c in (some, more))
    assert all(y <= x for x, y in zip(ra, rb, strict=True))


def test_empty_and_blocked(spark):
    rays = raycast.ray_cells(spark)
    none = raycast.first_hits(occupied(spark, [(0, 0)]).limit(0), rays)
    m = metrics.measures(rings(spark, none), raycast.shadow_counts(none, rays)).first()
    assert (m.l_vis, m.a_shadow, m.h_leak, m.n_edges, m.grade) == (60.0, 0.0, 0.0, 0, "Safe") and abs(m.dsi - 27.948745635820465 / 60 * 1.15) < 1e-12
    full = raycast.first_hits(occupied(spark, [DEFAULT.center]), rays)
    assert raycast.shadow_counts(full, rays).first().shadow_cells == 44_595
    b = metrics.measures(rings(spark, full), raycast.shadow_counts(full, rays)).first()
    assert b.l_vis == 0.0 and b.n_edges == 0 and b.grade == "High-risk" and b.a_shadow == 11_148.75


@pytest.mark.parametrize("ray", [0, 719])
def test_edges_wrap(spark, ray):
    hits = spark.createDataFrame([(1, "occ", ray, ray * 0.5, 20)], "pano int, variant string, ray int, ang double, hit_s int")
    ring = rings(spark, hits)
    assert metrics.emergence_edges(ring).count() == 2 and metrics.emergence_edges(ring, wrap=False).count() == 1
    assert {r.ang for r in metrics.emergence_edges(ring).collect()} == {ray * 0.5}


def test_gap_and_weight_bounds(spark):
    ring = [60.0] * 720
    ring[100], ring[101] = 10.0, 13.0  # a gap of exactly 3
    ring[300] = 40.0  # weight 0
    df = spark.createDataFrame([(1, "occ", ring)], "pano int, variant string, ring array<double>")
    got = sorted((r.ang, r.dist) for r in metrics.emergence_edges(df).collect())
    assert got == sorted((a, d) for a, d, _ in model.edges(ring)) and (150.0, 40.0) not in got and (50.0, 10.0) in got


def test_calibration(spark):
    rng = np.random.default_rng(0)
    rows = []
    for pano, n, noise, slope in ((1, 299, 0.0, 1), (2, 300, 0.0, 1), (3, 400, 5.0, 1), (4, 400, 0.0, -1), (5, 400, None, 1)):
        for i in range(n):
            v = 140 + i % 50
            x = 0.3 + slope * 0.002 * (v - 128) + (noise or 0) * float(rng.normal())
            rows.append((pano, "front", v, 0.0 if noise is None else float(1 - x)))
    got = {r.pano: r for r in calibrate.calibrate(spark.createDataFrame(rows, "pano int, dir string, v int, depth_norm double")).collect()}
    assert [got[p].source for p in (1, 2, 3, 4, 5)] == ["ipm", "depth", "ipm", "ipm", "ipm"]
    x = np.array([1 - d for p, _, v, d in rows if p == 3])
    y = np.array([(v - 128) / (2.5 * model.FX) for p, _, v, d in rows if p == 3])
    (a, b), *_ = np.linalg.lstsq(np.vstack([x, np.ones_like(x)]).T, y, rcond=None)
    r2 = 1 - ((y - a * x - b) ** 2).sum() / (((y - y.mean()) ** 2).sum() + 1e-9)
    assert abs(got[3].a - a) < 1e-9 and abs(got[3].b - b) < 1e-9 and abs(got[3].r2 - r2) < 1e-9


def test_small_blockers_become_other(spark):
    flags = vocabulary.class_flags(adapters.class_dim(spark))
    rows = [(1, "front", u, v, 1) for u in range(20) for v in range(150, 160)]  # 200 pixels of wall
    rows += [(1, "left", u, v, 1) for u in range(20) for v in range(150, 160)][:-1]  # 199
    rows += [(1, "back", u, v, 3) for u in range(20) for v in range(150, 170)]  # blocker and ground
    got = {(r.dir, r.layer) for r in masks.base_pixels(masks.with_obstacles(masks.column_classes(spark.createDataFrame(rows, "pano int, dir string, u int, v int, class_id int"), flags))).collect()}
    assert got == {("front", "occ"), ("left", "other")}


def test_links_break_at_gaps_and_jumps(spark):
    rows = [(1, "front", "occ", i, 2 * i, z) for i, z in [(10, 10.0), (11, 13.99), (12, 17.99), (14, 18.0), (15, 18.1)]]
    df = spark.createDataFrame(rows, "pano int, dir string, layer string, i int, u int, z float")
    got = {r.i: r.from_col is not None for r in footprint.linked(footprint.projected(df)).collect()}
    assert got == {10: False, 11: True, 12: False, 14: False, 15: True}


def test_half_even_cells(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (1.25,), (-0.25,)], "x double")
    col, _ = geometry.cell_of(F.col("x"), F.lit(0.0), F.lit(0.0), (120, 120))
    assert [r.c for r in df.select(col.alias("c")).collect()] == [round(120 + x / 0.5) for x in (0.25, 0.75, 1.25, -0.25)]


def test_cameras_and_crops(spark):
    cams = {r.direction: r for r in crop.cameras(spark.createDataFrame([("p", "p.jpg", 1026, 256)], "pano string, src_image string, width int, height int")).collect()}
    assert cams["front"].fx == 128.0 / math.tan(math.radians(90) / 2) and cams["back"].yaw_deg == 180.0 and cams["left"].out_hw == [256, 256] and cams["right"].split == [2, 4]
    image = (np.arange(4 * 18 * 3) % 251).astype(np.uint8).reshape(4, 18, 3)
    df = spark.createDataFrame([("p", ("f", 4, 18, 3, 16, bytearray(image.tobytes())))], "pano string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    for r in crop.crop_images(df).collect():
        assert np.array_equal(np.frombuffer(r.image.data, np.uint8).reshape(4, 4, 3), image[:, r.dir_idx * 4 : r.dir_idx * 4 + 4])


def test_models_are_given(spark):
    image = np.arange(4 * 4 * 3, dtype=np.uint8).reshape(4, 4, 3)
    df = spark.createDataFrame([("p", "front", ("f", 4, 4, 3, 16, bytearray(image.tobytes())))], "pano string, dir string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")

    def load():
        return lambda batch: [b[:, :, 0].astype(np.int32) % 7 for b in batch]

    got = {(r.u, r.v): r.class_id for r in infer.segment(df, load).collect()}
    assert got == {(u, v): int(image[v, u, 0]) % 7 for u in range(4) for v in range(4)}
    depth = {(r.u, r.v): r.depth_norm for r in infer.estimate_depth(df, load).collect()}
    raw = (image[:, :, 0] % 7).astype(float)
    want = 1 - (raw - raw.min()) / (raw.max() - raw.min() + 1e-8)
    assert all(abs(depth[u, v] - want[v, u]) < 1e-6 for u in range(4) for v in range(4))
    flat = infer.normalise(spark.createDataFrame([("p", "front", 0, 0, 5.0), ("p", "front", 1, 0, 5.0)], "pano string, dir string, u int, v int, disparity double"))
    assert {r.depth_norm for r in flat.collect()} == {1.0}


def test_samples(spark):
    import random

    keys = spark.createDataFrame([(f"p{i:03d}",) for i in range(57)], "pano string").repartition(5)
    want = sorted(random.Random(41).sample(sorted(f"p{i:03d}" for i in range(57)), 10))
    assert [r.pano for r in sampling.seeded_sample(keys, "pano", 10, 41).collect()] == want
    assert sampling.seeded_sample(keys.limit(3), "pano", 10, 41).count() == 3 and sampling.seeded_sample(keys.limit(0), "pano", 10, 41).count() == 0
    assert sampling.unseeded_sample(keys, 6).count() == 6
    assert sampling.remaining(keys, keys.where("pano < 'p050'")).count() == 7


def test_renders(spark):
    layers = spark.createDataFrame([(1, "road", 3, 3), (1, "occ", 3, 3), (1, "sidewalk", 4, 4), (1, "veh_side", 5, 5)], "pano int, layer string, col int, row int")
    shown = {(r.col, r.row): (r.r, r.g, r.b) for r in render.composite(layers).collect()}
    assert shown == {(3, 3): (220, 80, 80), (4, 4): (200, 180, 140), (5, 5): (255, 140, 0)}
    shadow = spark.createDataFrame([(1, 5, 5)], "pano int, col int, row int")
    assert {(r.r, r.g, r.b) for r in render.hazard_composite(layers, shadow).where("col = 5").collect()} == {(255, 235, 150)}
    full = render.dense(render.composite(layers), spark.createDataFrame([(1,)], "pano int"))
    assert full.count() == 240 * 240 and full.where("r = 200 and g = 200").count() == 240 * 240 - 3
    table = spark.createDataFrame([(i, i / 255, 0.0, 1.0) for i in range(256)], "level int, r double, g double, b double")
    one = render.colour_map(spark.createDataFrame([(1, "front", 0, 0, 1.0), (1, "front", 1, 0, 0.5)], "pano int, dir string, u int, v int, depth_norm double"), table).collect()
    assert {(x.u, x.r, x.b) for x in one} == {(0, 255, 255), (1, 128, 255)}


def test_record_of_missing_parts(spark):
    """No masks, no depth, a direction without pixels: still a record."""
    flags = vocabulary.class_flags(adapters.class_dim(spark))
    none = spark.createDataFrame([], "pano int, dir string, u int, v int, class_id int")
    present = spark.createDataFrame([(1, "front"), (1, "left"), (2, "back")], "pano int, dir string")
    got = {r.pano: r for r in analysis.records(none, flags, present).collect()}
    assert got[1].dirs_present == ["left", "front"] and got[1].occ_source == {"left": "ipm", "front": "ipm"} and got[2].l_vis_m == 60.0
    assert got[1].dsi_refined == 0.5357 and got[1].grade == got[1].grade_veh == "Safe" and got[1].hazard_edges == 0
    plain = analysis.records(none, flags, present, DEFAULT.replace(include_vehicles=False))
    assert "dsi_veh" not in plain.columns and plain.count() == 2


@pytest.mark.parametrize("size,to", [(16, 4), (16, 16), (6, 15), (10, 7)])
def test_resized_bilinear(spark, size, to):
    rng = np.random.default_rng(size)
    image = rng.integers(0, 256, (size, size, 3))
    df = spark.createDataFrame([(1, "front", u, v, *map(int, image[v, u])) for u in range(size) for v in range(size)], "pano int, dir string, u int, v int, b int, g int, r int")
    at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
    weights = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(size)))
    want = np.floor(np.round(np.einsum("yv,xu,vuc->yxc", weights, weights, image), 6) + 0.5).astype(int)
    got = {(r.u, r.v): (r.b, r.g, r.r) for r in render.resized_bilinear(df, size, size, to).collect()}
    assert got == {(x, y): tuple(want[y, x].tolist()) for x in range(to) for y in range(to)}


def test_required_inputs(spark):
    from streetlens.sources import records

    crops = spark.createDataFrame([(1, "front"), (2, "left")], "pano int, dir string")
    assert sorted(records.required_inputs(crops, crops, crops).collect()) == sorted(crops.collect())
    with pytest.raises(Exception, match="no depth of 2 left"):
        records.required_inputs(crops, crops, crops.where("pano = 1")).collect()


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from streetlens.sources import session

    def named(master, folder=""):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d="": folder), sparkContext=SimpleNamespace(master=master))

    assert session.shared_folder(named("spark://a:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_folder(named("local[4]")) == session.shared_folder(named("local"))
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(named(master))
