"""Mixing sources to target weights by capped water-filling.

Sources share a total by weight, but none exceeds its size times the largest number
of epochs. Clamping full sources and resharing their excess until nothing is above
its cap ends at ``target = min(cap, level * weight)``; with sources sorted by
cap / weight the level is a prefix sum away, so no rounds are needed. Targets become
whole and fractional repetitions: every document is taken floor(target / size)
times, and one more time, in seeded order, while the remainder lasts; the document
at its end is taken in part, so that a source meets its target to a word.

Built-in functions only. Running sums go over hash buckets of a source and then
within a bucket, since a source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm.common import WORD

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 7
#: Leading hex digits of the seeded order that name a bucket: 4096 in each source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for a table of one row per source: source (null: last), source_size.

    Weights repeat over the sources by code point. Returns source, source_size,
    weight, target. A total of 0 gives targets of 0. One window over all sources:
    the table has a row for each source, not for each document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long"))
    # exact: caps and weights are integers, and ties in the ratio give the same level
    by_ratio = Window.orderBy((F.col("source_size") * max_epochs / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    filled = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        # the first source that its share does not fill sets the level of all behind it
        .withColumn("fits", F.col("level") * F.col("weight") <= cap)
        .withColumn("level", F.coalesce(F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    )
    return filled.select("source", "source_size", "weight", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(df: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """What the mix takes of each document of df (doc_id, text, source).

    Null sources form one source, sorted last; null and empty texts have size 0 and
    nothing of them is taken; repeated rows are documents of their own; an empty
    table gives no rows; other columns are left out, or carried in the struct `row`.
    Returns doc_id, source, size, source_size, target, taken, and row if asked for."""
    row = [F.struct("*").alias("row")] if carry else []
    kept = ["row"] if carry else []
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))))
    docs = df.select("doc_id", "source", *row, word_count(F.col("text")).alias("size"), order.alias("__order"))
    docs = docs.withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS))
    parts = docs.groupBy("source", "__bucket").agg(F.sum("size").alias("__part"))
    goal = targets(parts.groupBy("source").agg(F.sum("__part").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("__of"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__part").over(earlier), F.lit(0)).alias("__offset"))
    plan = offsets.join(goal, F.col("__of").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "__bucket").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("__start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__at"))
    )
    goal_words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal_words - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__offset") - F.col("__start")))
    return placed.select("doc_id", "source", *kept, "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """A mix that carries its rows, as rows: each document as often as taken says, whole
    documents only; of the one document in a source that is taken in part, the part is
    rounded. The columns are those of the table that was mixed."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    taken = mixed.select("row", copies.alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
