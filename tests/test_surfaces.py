"""Surfaces and vehicles of crops that are runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from streetlens.config import DIRECTIONS
from streetlens.functions import vocabulary
from streetlens.operators import components, footprint, surfaces
from streetlens.operators.runs import Runs
from streetlens.plans import analysis
from streetlens.plans.queries import QUERIES
from streetlens.sources import adapters


@pytest.fixture(scope="module")
def runs(spark):
    """Columns of runs of classes 4 to 8, some of them next to each other; panoramas of up to four directions, one null."""
    rng = random.Random(5)
    crops = []
    for pano in (None, "a", "b", "c", "d", "e"):
        for _, name, _ in DIRECTIONS[: rng.randint(1, 4)]:
            words = []
            for u in range(0, 256, rng.choice((1, 3))):
                v = rng.randint(100, 140)
                while v < 255:
                    end = min(255, v + rng.randint(0, 14))
                    word = u | v << 8 | end << 16 | rng.randint(4, 8) << 24
                    words.append(word)
                    v = end + 1 + rng.choice((0, 0, 1, 9))
            rng.shuffle(words)
            crops.append((pano, name, words))
    return Runs(spark.createDataFrame(crops, "pano string, dir string, runs array<int>"))


@pytest.fixture(scope="module")
def flags(spark):
    return vocabulary.class_flags(adapters.class_dim(spark))


def same(a, b) -> bool:
    b = b.select(*a.columns)
    return a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("rows", ["3", "10000"])
def test_surfaces_are_those_of_pixels(spark, runs, flags, rows):
    layer = F.explode(F.expr("filter(array(if(is_road, 'road', null), if(is_sidewalk, 'sidewalk', null)), x -> x is not null)"))
    px = runs.pixels().join(flags, "class_id").withColumn("layer", layer)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    want = footprint.ground_surface(px).cache()
    try:
        spark.conf.set(name, rows)  # panoramas go over batches
        assert same(surfaces.ground_surface(runs, flags), want)
    finally:
        spark.conf.set(name, before)


def test_vehicles_are_those_of_pixels(runs, flags):
    of_runs = analysis.vehicle_pixels(runs, flags)
    px = runs.pixels(flags.where("is_vehicle and not is_ground")).where("v < 192")
    assert same(components.joined_runs(of_runs), components.vertical_runs(px))
    assert same(components.vehicle_base(of_runs), components.vehicle_base(px))


def test_merged_layers_numbers_no_pixels(spark, sf):
    plan = QUERIES["merged_layers"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "MapInArrow" in plan
