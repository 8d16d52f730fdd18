"""Images as files: pixels and grids encoded as PNG, one image at a time.

JPEG has no encoder among the requirements; PNG needs zlib only and loses nothing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.config import DEFAULT, NO_DATA_RGB, Config


def png(rgb: np.ndarray) -> bytes:
    """An image of rows, columns and red, green, blue as PNG."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def grid_images(composed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One image for each panorama of a composed grid (pano, col, row, r, g, b): name, data.
    A call holds one panorama's cells, which the grid bounds."""

    def draw(cells: pd.DataFrame) -> pd.DataFrame:
        image = np.empty((config.canvas, config.canvas, 3), np.uint8)
        image[:] = NO_DATA_RGB
        image[cells["row"], cells["col"]] = cells[["r", "g", "b"]]
        return pd.DataFrame({"name": [f"{cells['pano'].iloc[0]}_bev360.png"], "data": [png(image)]})

    return composed.groupBy("pano").applyInPandas(draw, "name string, data binary")


def crop_files(crops: DataFrame) -> DataFrame:
    """Crops (pano, dir, image) as PNG: name, data."""

    @F.pandas_udf("binary")
    def encode(image: pd.DataFrame) -> pd.Series:
        rows = zip(image["data"], image["height"], image["width"], image["nChannels"], strict=True)
        return pd.Series([png(np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, 2::-1]) for d, h, w, c in rows])

    return crops.select(F.concat_ws("_", F.col("pano").cast("string"), F.concat("dir", F.lit(".png"))).alias("name"), encode("image").alias("data"))


def write_files(files: DataFrame, uri: str) -> None:
    """Write rows (name, data) as files of a folder that all executors reach. A task that
    runs again writes the same files."""

    def write(rows: Iterator) -> None:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(uri)
        where.create_dir(root, recursive=True)
        for row in rows:
            with where.open_output_stream(f"{root}/{row['name']}") as out:
                out.write(bytes(row["data"]))

    files.foreachPartition(write)
