"""Lines, dilation and closing on sparse grids (pano, layer, col, row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The cells of an 8-connected line as an array of (col, row), its end cells included."""
    swap = x0 > x1
    ax, ay = F.when(swap, x1).otherwise(x0), F.when(swap, y1).otherwise(y0)
    bx, by = F.when(swap, x0).otherwise(x1), F.when(swap, y0).otherwise(y1)
    dx, dy = bx - ax, F.abs(by - ay)
    sy = F.signum(by - ay).cast("int")
    long, short = F.greatest(dx, dy), F.least(dx, dy)

    def point(k: Column) -> Column:
        off = F.when(long == 0, F.lit(0)).otherwise(F.floor((2 * short * k + long - 1) / (2 * long))).cast("int")
        return F.struct(F.when(dy > dx, ax + off).otherwise(ax + k).alias("col"), F.when(dy > dx, ay + sy * k).otherwise(ay + sy * off).alias("row"))

    return F.transform(F.sequence(F.lit(0), long), point)


def _words(width: int) -> list[str]:
    return [f"w{k}" for k in range(-(-width // 64))]


def packed(cells: DataFrame, width: int) -> DataFrame:
    """Cells as rows of bits: the keys, row, and 64 columns in each of w0, w1, ..."""
    keys = [c for c in cells.columns if c not in ("col", "row")]
    bit = F.expr("shiftleft(1L, col % 64)")
    return cells.groupBy(*keys, "row").agg(*[F.bit_or(F.when(F.expr("col div 64") == k, bit).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(_words(width))])


def unpacked(rows: DataFrame, width: int) -> DataFrame:
    """The cells of rows of bits."""
    words = _words(width)
    keys = [c for c in rows.columns if c not in (*words, "row")]
    every = rows.select(*keys, "row", F.array(*words).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    return every.where(F.expr("shiftright(w[col div 64], col % 64) & 1L = 1")).select(*keys, "col", "row")


def blocks(cells: DataFrame) -> DataFrame:
    """Cells as words of bits: the keys, row, block and bits, the 64 columns from 64 * block."""
    keys = [c for c in cells.columns if c not in ("col", "row")]
    return cells.groupBy(*keys, "row", F.shiftright("col", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, col & 63)")).alias("bits"))


def unblocked(words: DataFrame) -> DataFrame:
    """The cells of words of bits."""
    keys = [c for c in words.columns if c not in ("row", "block", "bits")]
    every = words.select(*keys, "row", "block", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return every.where("shiftright(bits, bit) & 1L = 1").select(*keys, F.expr("cast(block * 64 + bit as int)").alias("col"), "row")


def _shifted(words: list[str], width: int, beyond: bool) -> tuple[list[Column], list[Column]]:
    """The bits of each column's neighbour to the left and to the right; what is beyond
    the edge counts as set or not."""
    edge = F.lit(int(beyond)).cast("long")
    left = [F.shiftleft(w, 1).bitwiseOR(F.shiftrightunsigned(words[k - 1], 63) if k else edge) for k, w in enumerate(words)]
    last = F.shiftleft(edge, (width - 1) % 64)
    right = [F.shiftrightunsigned(w, 1).bitwiseOR(F.shiftleft(words[k + 1], 63) if k + 1 < len(words) else last) for k, w in enumerate(words)]
    return left, right


def _cut(word: Column, k: int, width: int) -> Column:
    bits = min(64, width - 64 * k)
    return word if bits == 64 else word.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _dilated(rows: DataFrame, width: int, height: int) -> DataFrame:
    words = _words(width)
    keys = [c for c in rows.columns if c not in (*words, "row")]
    left, right = _shifted(words, width, False)
    wide = [_cut(F.col(w).bitwiseOR(x).bitwiseOR(y), k, width).alias(w) for k, (w, x, y) in enumerate(zip(words, left, right, strict=True))]
    spread = rows.select(*keys, *wide, F.explode(F.array(F.col("row") - 1, F.col("row"), F.col("row") + 1)).alias("row"))
    return spread.where((F.col("row") >= 0) & (F.col("row") < height)).groupBy(*keys, "row").agg(*[F.bit_or(w).alias(w) for w in words])


def _eroded(rows: DataFrame, width: int, height: int) -> DataFrame:
    words = _words(width)
    keys = [c for c in rows.columns if c not in (*words, "row")]
    left, right = _shifted(words, width, True)
    narrow = [F.col(w).bitwiseAND(x).bitwiseAND(y).alias(w) for w, x, y in zip(words, left, right, strict=True)]
    spread = rows.select(*keys, *narrow, F.explode(F.array(F.col("row") - 1, F.col("row"), F.col("row") + 1)).alias("row"))
    met = spread.where((F.col("row") >= 0) & (F.col("row") < height)).groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("n"), *[F.bit_and(w).alias(w) for w in words])
    needed = F.lit(3) - (F.col("row") == 0).cast("int") - (F.col("row") == height - 1).cast("int")
    return met.where(F.col("n") == needed).select(*keys, "row", *words)


def dilate(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells and their eight neighbours, inside the grid. A grid row is a few words of bits
    that are shifted and or-ed, so that a cell costs three rows of words and not nine."""
    return unpacked(_dilated(packed(cells, width), width, height), width)


def close(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Dilation, then erosion: a cell stays if all its neighbours in the grid are there."""
    return unpacked(_eroded(_dilated(packed(cells, width), width, height), width, height), width)
