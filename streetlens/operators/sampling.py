"""Fixed-size samples of panoramas, and what is left to do."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.sources.session import settled


def seeded_sample(keys: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """n keys (all, if fewer) drawn without replacement as Python's random module draws
    them from the sorted keys; in order.

    The draw needs positions only: the driver draws n numbers under the count, and the
    keys at those places of the sorted table are found by their place within a partition
    and the counts of the partitions before. No list of keys comes to the driver."""
    ordered = keys.select(F.col(column).alias("key")).distinct().orderBy("key")
    # the number of a row within its partition; the order is kept by the checkpoint
    numbered = settled(ordered.select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    counts = {r["part"]: r["count"] for r in numbered.groupBy("part").count().collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    places = sorted(random.Random(seed).sample(range(total), min(n, total)))
    if not places:
        return keys.select(column).limit(0)
    part_of = [max(p for p in starts if starts[p] <= k) for k in places]
    wanted = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k - starts[p]).cast("long").alias("at")) for p, k in zip(part_of, places, strict=True)])
    return numbered.where(F.array_contains(wanted, F.struct("part", "at"))).select(F.col("key").alias(column)).orderBy(column)


def unseeded_sample(keys: DataFrame, n: int) -> DataFrame:
    return keys.orderBy(F.rand()).limit(n)


def remaining(keys: DataFrame, done: DataFrame, column: str = "pano") -> DataFrame:
    """Keys that are not done yet; before any costly step."""
    return keys.join(done.select(column), column, "left_anti")
