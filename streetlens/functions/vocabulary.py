"""Which classes block, are ground, are vehicles: keywords that a class name holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A class belongs to a set if its lower-case name holds any of the words.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "blocker": (
        "building", "wall", "house", "skyscraper", "hovel", "tower", "fence", "hedge", "railing", "column", "pillar", "bannister",
        "canopy", "grandstand", "bulletin board", "tree", "plant", "palm", "flower", "pole", "awning", "signboard", "booth", "bridge",
        "streetlight", "sculpture", "flag", "mountain", "hill", "rock", "tent", "stairs", "stairway", "screen door",
    ),
    "ground": ("road", "sidewalk", "floor", "earth", "field", "grass", "path", "runway", "dirt track", "land", "sky"),
    "vehicle": ("car", "bus", "truck", "van", "minibike", "bicycle"),
    "road": ("road",),
    "sidewalk": ("sidewalk",),
}


def in_set(name: Column, keywords: str) -> Column:
    low = F.lower(name)
    return F.coalesce(F.exists(F.array(*[F.lit(k) for k in KEYWORDS[keywords]]), lambda k: F.contains(low, k)), F.lit(False))


def class_flags(classes: DataFrame) -> DataFrame:
    """class_id, name and a flag for each set; a class may be in several sets, or none."""
    return classes.select("class_id", "name", *[in_set(F.col("name"), k).alias(f"is_{k}") for k in KEYWORDS])


def keyword_table(classes: DataFrame) -> DataFrame:
    """The same as rows: class_id, set_name, the first keyword that matches."""
    sets = F.array(*[F.struct(F.lit(s).alias("set_name"), F.array(*[F.lit(k) for k in ks]).alias("kws")) for s, ks in KEYWORDS.items()])
    met = classes.select("class_id", F.lower("name").alias("low"), F.explode(sets).alias("s"))
    first = F.filter(F.col("s.kws"), lambda k: F.contains(F.col("low"), k))
    return met.select("class_id", F.col("s.set_name").alias("set_name"), F.get(first, F.lit(0)).alias("kw")).where("kw is not null")


def listing(flags: DataFrame, keywords: str) -> DataFrame:
    """The classes of a set by number."""
    return flags.where(f"is_{keywords}").select("class_id", "name").orderBy("class_id")


def class_colours(blockers: list[int], seed: int = 42) -> dict[int, tuple[int, int, int]]:
    """A colour (BGR) for each blocker class, drawn in the order given."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return {c: tuple(int(x) for x in rng.integers(40, 230, 3)) for c in blockers}
