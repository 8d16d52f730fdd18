"""Ground surfaces of crops that are runs: the cells of footprint.ground_surface.

A crop has some thousand ground pixels, which are numbered, projected, joined by lines and
closed here within a panorama's arrays; rows are made of the cells only. Where a pixel lies
in the grid follows from its direction and place alone, and is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, DIRECTIONS, Config
from streetlens.functions.geometry import cell_of, ground_distance, lateral, on_grid, yaw_of
from streetlens.operators.layout import by_pano
from streetlens.operators.runs import Runs

LAYERS = ("road", "sidewalk")
#: Crops whose grids are in memory at once, but for those of one panorama.
CROPS = 32


def cell_table(spark: SparkSession, config: Config = DEFAULT) -> np.ndarray:
    """The cell (row * canvas + col) of the ground in each direction, u and v; -1 where
    there is none. It depends on the configuration only."""
    names = [name for _, name, _ in DIRECTIONS]
    size, width = config.crop_width * config.crop_height, config.crop_width
    at = spark.range(len(names) * size, numPartitions=1).select("id", F.element_at(F.array(*map(F.lit, names)), F.expr(f"cast(id div {size} + 1 as int)")).alias("dir"), F.expr(f"cast(id % {width} as int)").alias("u"), F.expr(f"cast(id % {size} div {width} as int)").alias("v"))
    z = ground_distance(F.col("v"), config)
    col, row = cell_of(lateral(F.col("u"), F.col("z"), config), F.col("z"), yaw_of(F.col("dir")), config.center, config)
    points = at.withColumn("z", z).where("z is not null").select("id", col.alias("col"), row.alias("row")).where(on_grid(F.col("col"), F.col("row"), config.canvas, config.canvas))
    found = points.select("id", (F.col("row") * config.canvas + F.col("col")).alias("cell")).toArrow()
    table = np.full(len(names) * size, -1, np.int32)
    table[found["id"].to_numpy()] = found["cell"].to_numpy()
    return table.reshape(len(names), config.crop_height, config.crop_width)


def sampled(grid: np.ndarray, u: np.ndarray, top: np.ndarray, bottom: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every step-th pixel of the runs of each image column, counted over all its runs: the
    run of each, its v and its number. Runs are in order of grid, u and top."""
    n = bottom - top + 1
    before = np.cumsum(n) - n
    first = np.ones(len(n), bool)
    first[1:] = (grid[1:] != grid[:-1]) | (u[1:] != u[:-1])
    before -= before[np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))]
    off = -before % step
    many = np.maximum(0, -(-(n - off) // step))
    run = np.repeat(np.arange(len(n)), many)
    j = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    return run, (top + off)[run] + j * step, ((before + off) // step)[run] + j


def lines(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """raster.line_points: the line, col and row of each cell."""
    swap = x0 > x1
    ax, ay, bx, by = np.where(swap, x1, x0), np.where(swap, y1, y0), np.where(swap, x0, x1), np.where(swap, y0, y1)
    dx, dy, sy = bx - ax, np.abs(by - ay), np.sign(by - ay)
    long, short = np.maximum(dx, dy), np.minimum(dx, dy)
    line = np.repeat(np.arange(len(long)), long + 1)
    k = np.arange(len(line)) - np.repeat(np.cumsum(long + 1) - long - 1, long + 1)
    over = np.maximum(long, 1)[line]
    off = (2 * short[line] * k + long[line] - 1) // (2 * over)
    off[long[line] == 0] = 0
    steep = (dy > dx)[line]
    return line, ax[line] + np.where(steep, off, k), ay[line] + sy[line] * np.where(steep, k, off)


def closed(grids: np.ndarray) -> np.ndarray:
    """raster.close of grids of booleans (..., row, col)."""

    def near(x: np.ndarray, join) -> np.ndarray:
        out = x.copy()
        join(out[..., 1:, :], x[..., :-1, :], out=out[..., 1:, :])
        join(out[..., :-1, :], x[..., 1:, :], out=out[..., :-1, :])
        wide = out.copy()
        join(wide[..., 1:], out[..., :-1], out=wide[..., 1:])
        join(wide[..., :-1], out[..., 1:], out=wide[..., :-1])
        return wide

    return near(near(grids, np.logical_or), np.logical_and)


def ground_surface(runs: Runs, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cells (pano, layer, col, row) of the layers road and sidewalk; flags: class_id,
    is_road, is_sidewalk, as few as a model's classes."""
    spark = runs.crops.sparkSession
    known = flags.where("is_road or is_sidewalk").select("class_id", *[f"is_{name}" for name in LAYERS]).collect()
    of_class = np.zeros((len(LAYERS), 256), bool)
    for row in known:
        of_class[:, row[0]] |= [bool(x) for x in row[1:]]
    table = cell_table(spark, config)
    number = {name: i for i, name, _ in DIRECTIONS}
    side, step = config.canvas, config.subsample

    def cells(crops: pa.RecordBatch, pano: np.ndarray) -> pa.RecordBatch:
        """Crops of whole panoramas, which pano numbers from 0, to rows of cells."""
        lists = crops.column(2)
        at = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        words = lists.flatten().to_numpy(zero_copy_only=False)
        direction = np.array([number.get(x, -1) for x in crops.column(1).to_pylist()], np.int32)
        kept = ((words & 255) % step == 0) & of_class.any(0)[words >> 24 & 255] & (direction[at] >= 0)
        at, words = at[kept], words[kept]
        grids = np.zeros((len(LAYERS), len(lists), side * side), bool)
        for layer in range(len(LAYERS)):
            own = of_class[layer][words >> 24 & 255]
            grid, r = at[own], words[own]
            u, top, bottom = r & 255, r >> 8 & 255, r >> 16 & 255
            order = np.lexsort((top, u, grid))
            grid, u, top, bottom = grid[order], u[order], top[order], bottom[order]
            run, v, k = sampled(grid, u, top, bottom, step)
            cell = table[direction[grid[run]], v, u[run]]
            run, v, k, cell = (x[cell >= 0] for x in (run, v, k, cell))
            joined = np.zeros(len(run), bool)
            joined[1:] = (grid[run[1:]] == grid[run[:-1]]) & (u[run[1:]] == u[run[:-1]]) & (np.diff(k) == 1) & (np.diff(v) <= 2 * step)
            start = cell.copy()
            start[1:][joined[1:]] = cell[:-1][joined[1:]]
            line, col, row = lines(start % side, start // side, cell % side, cell // side)
            grids[layer, grid[run[line]], row * side + col] = True
        shut = closed(grids.reshape(len(LAYERS), len(lists), side, side)).reshape(grids.shape)
        first = np.flatnonzero(np.diff(pano, prepend=-1))
        merged = np.logical_or.reduceat(shut, first, axis=1)  # directions meet
        found = [np.flatnonzero(x).astype(np.int32) for layer in merged for x in layer]
        ids = pa.array(np.tile(first, len(LAYERS)))
        cells_of = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
        names = pa.array(np.repeat(LAYERS, len(first)).tolist(), pa.string())
        return pa.RecordBatch.from_arrays([crops.column(0).take(ids), names, cells_of], names=["pano", "layer", "cells"])

    def of_panos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if rest is None:
                return
            ids = rest.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.append(0, np.flatnonzero(np.diff(ids)) + 1)
            end = int(new[-1]) if batch is not None else rest.num_rows  # the last panorama may go on in the next batch
            bounds = [*new[new < end].tolist(), end]
            number_of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(ids))))
            a = 0
            while a < len(bounds) - 1:
                b = a + 1
                while b < len(bounds) - 1 and bounds[b + 1] - bounds[a] <= CROPS:
                    b += 1
                yield cells(rest.slice(bounds[a], bounds[b] - bounds[a]), number_of[bounds[a] : bounds[b]] - a)
                a = b
            rest = rest.slice(end) if end < rest.num_rows else None

    kind = runs.crops.schema["pano"].dataType.simpleString()
    dealt = by_pano(runs.crops.select("pano", "dir", "runs")).sortWithinPartitions("pano")
    found = dealt.mapInArrow(of_panos, f"pano {kind}, layer string, cells array<int>")
    every = found.select("pano", "layer", F.explode("cells").alias("cell"))
    return every.select("pano", "layer", F.expr(f"cell % {side}").alias("col"), F.expr(f"cast(cell div {side} as int)").alias("row"))

