"""Images, records, resuming and the stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from streetlens.functions import vocabulary
from streetlens.operators import crop, sampling
from streetlens.plans import analysis
from streetlens.sources import adapters, images, records


def write_image(spark, path, array, kind="png"):
    jvm = spark.sparkContext._jvm
    h, w, _ = array.shape
    image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    for v in range(h):
        for u in range(w):
            b, g, r = (int(x) for x in array[v, u])
            image.setRGB(u, v, (r << 16) | (g << 8) | b)
    jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_panoramas_and_crops(spark, tmp_path):
    rng = np.random.default_rng(0)
    pano = rng.integers(0, 255, (6, 18, 3)).astype(np.uint8)
    write_image(spark, tmp_path / "a_b.png", pano)
    (tmp_path / "junk.png").write_bytes(b"no image")
    (tmp_path / "exclude").mkdir()
    write_image(spark, tmp_path / "exclude" / "c.png", pano)
    got = images.read_panoramas(spark, str(tmp_path), "*.png")
    assert [(r.pano, r.src_image) for r in got.collect()] == [("a_b", "a_b.png")]
    crops = crop.crop_images(got).withColumn("image", F.col("image"))
    px = {(r.dir, r.u, r.v): (r.b, r.g, r.r) for r in images.pixels(crops).collect()}
    assert len(px) == 4 * 4 * 6 and all(px[n, u, v] == tuple(pano[v, i * 4 + u]) for i, n in enumerate(("left", "front", "right", "back")) for u in range(4) for v in range(6))
    named = tmp_path / "crops"
    named.mkdir()
    for name in ("p_front", "p_left", "q_left", "other"):
        write_image(spark, named / f"{name}.png", pano[:, :4])
    read = images.read_crops(spark, str(named), "*.png")
    assert sorted((r.pano, r.dir) for r in read.collect()) == [("p", "front"), ("p", "left"), ("q", "left")]
    assert [r.pano for r in images.panorama_names(read).collect()] == ["p"]
    assert images.thumbnails(read, read.where("dir = 'left'")).count() == 3


def test_cameras_round_trip(spark, tmp_path):
    cams = crop.cameras(spark.createDataFrame([("p", "p.jpg", 1024, 256)], "pano string, src_image string, width int, height int"))
    records.write_json(cams, str(tmp_path / "cams"))
    back = records.read_cameras(spark, str(tmp_path / "cams" / "*.json"))
    assert spark.read.schema(cams.schema).json(str(tmp_path / "cams")).exceptAll(cams).count() == 0 and back.columns == cams.columns
    crops = spark.createDataFrame([("p", "front"), ("p", "up")], "pano string, dir string")
    assert records.crops_with_cameras(crops, cams).count() == 1


def test_resume(spark, sf, tmp_path):
    flags = vocabulary.class_flags(adapters.class_dim(spark))
    labels = adapters.label_px(spark, sf).withColumn("pano", F.col("pano").cast("string"))
    path = str(tmp_path / "dsi")
    assert records.read_records(spark, path).count() == 0
    first = analysis.records(labels.where("pano in ('1', '2', '3')"), flags)
    records.write_json(first, path)
    left = sampling.remaining(labels.select("pano").distinct(), records.read_records(spark, path))
    assert left.count() == 7
    records.write_json(analysis.records(labels.join(left, "pano", "left_semi"), flags), path)
    every = records.read_records(spark, path)
    assert every.count() == 10 and every.select("pano").distinct().count() == 10 and records.summary(every).agg(F.sum("panos")).first()[0] == 10


def test_meta(spark, sf, tmp_path):
    crops = adapters.panoramas(spark, sf)
    assert records.depth_meta(crops).where("depth_scale = 50").count() == crops.count()
    records.write_stage(records.depth_meta(crops), str(tmp_path / "m"))
    meta = spark.createDataFrame([("a.jpg", []), ("b.jpg", [])], "image string, detections array<struct<class_id:int>>")
    assert records.segmented(meta, spark.createDataFrame([("a.jpg",)], "image string")).count() == 1


def test_stream(spark, sf, tmp_path):
    from streetlens.streaming.crops import stream_records

    flags = vocabulary.class_flags(adapters.class_dim(spark))
    px = adapters.label_px(spark, sf).select(F.col("pano").cast("string").alias("pano"), "dir", F.col("u").cast("int"), F.col("v").cast("int"), "class_id", F.lit(0.0).cast("float").alias("depth_norm"))
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    px.where("pano = '1'").coalesce(1).write.parquet(where[0])
    stream_records(spark, where[0], flags, *where[1:]).awaitTermination()
    px.where("pano = '2'").coalesce(1).write.mode("append").parquet(where[0])
    stream_records(spark, where[0], flags, *where[1:]).awaitTermination()
    got = spark.read.parquet(where[1])
    want = analysis.records(px.where("pano in ('1', '2')"), flags)
    assert sorted((r.pano, r.dsi_veh) for r in got.collect()) == sorted((r.pano, r.dsi_veh) for r in want.collect())


def test_files(spark, tmp_path):
    from streetlens.sources import figures

    composed = spark.createDataFrame([(7, 3, 5, 255, 140, 0)], "pano int, col int, row int, r int, g int, b int")
    folder = f"file://{tmp_path}/figures"
    figures.write_files(figures.grid_images(composed), folder)
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (4, 5, 3)).astype(np.uint8)
    crops = spark.createDataFrame([("p", "front", ("f", 4, 5, 3, 16, bytearray(image.tobytes())))], "pano string, dir string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    figures.write_files(figures.crop_files(crops), folder)
    read = {r.image.origin.rpartition("/")[2]: r.image for r in spark.read.format("image").load(folder).collect()}
    grid = np.frombuffer(read["7_bev360.png"].data, np.uint8).reshape(240, 240, 3)
    assert tuple(grid[5, 3]) == (0, 140, 255) and tuple(grid[0, 0]) == (200, 200, 200)
    assert np.array_equal(np.frombuffer(read["p_front.png"].data, np.uint8).reshape(4, 5, 3), image)
