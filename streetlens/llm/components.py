"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.common import checkpointed

MAX_ROUNDS = 60
#: Edges (1 MB) that one task may gather, where a round over all partitions costs more.
FEW = 1 << 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "at")
    return both.where("v > u").join(least, F.col("u") == F.col("at")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
    joined = down.join(least, F.col("u") == F.col("at"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of all edges of a task, by a union of sets whose root is the smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in list(parent) if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], names=["u", "v"])


def connected(edges: DataFrame) -> DataFrame:
    """Edges (u long, v long, u != v) to stars (u, v): v is the smallest node of u's
    component, for every u but that one.

    Alternating large and small stars end in O(log^2 n) rounds. Each node's smallest
    neighbour is a partial aggregate joined back, so that a hub's edges can be split
    over tasks; a reliable checkpoint after each round cuts lineage. Once edges are few,
    whatever the input's size, one task ends it: a round of them writes little but files."""
    now = checkpointed(edges.distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            return now
        if state[0] <= FEW:
            return checkpointed(now.coalesce(1).mapInArrow(_gathered, "u long, v long"))
        after = checkpointed(_small_star(_large_star(now)))
        reached = _state(after)
        if reached == state:
            return after
        now, state = after, reached
    raise RuntimeError("components did not settle")
