"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_pano(df: DataFrame) -> DataFrame:
    """Deal the few rows that a panorama has before they become many.

    Profiles, points and hits are small, and Spark would merge their partitions into a
    task or two; what grows out of them (lines, neighbours, samples behind a hit) is some
    hundred times more, and is grouped by panorama and more. Dealt by panorama beforehand,
    none of it is shuffled. A panorama's rows are bounded by its images and its grid."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pano")
