"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of the key and the child's name, and the smallest
draw wins: a child wins with the probability of its share of the weights, and a
child whose weight changes only gains or loses rows itself. The weight of an inner
node is the sum below it. Adding a shard as a region of its own therefore moves
rows into that shard and nowhere else; a shard added to an existing rack moves rows
into that rack's subtree only.

All expressions are built-in; a row meets as many draws as the three levels have
children on its path, not one for each shard.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_011
#: Hash buckets of a shard in which slots are numbered apart from each other, and rows
#: that are numbered in one piece where many are equal.
SLOT_BUCKETS, PIECE = 1024, 8192


@dataclasses.dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, racks_per_region: int = 3, shards_per_rack: int = 4) -> list[Leaf]:
    """A tree of equal shards, filled rack by rack and region by region."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    per_region = racks_per_region * shards_per_rack
    return [Leaf(s // per_region, s % per_region // shards_per_rack, s) for s in range(shards)]


def with_shard(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region: rows move into it only."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _draw(key: Column, level: str, child: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child, F.lit(seed)), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def _winner(key: Column, level: str, children: Column, seed: int) -> Column:
    """The child (a struct of name and weight) with the smallest draw."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, level, c["name"], c["weight"], seed).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _children(pairs: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).cast("int").alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(pairs)])


def place(key: Column, tree: list[Leaf], seed: int = SEED) -> tuple[Column, Column, Column]:
    """Columns of the region, rack and shard for a key; a null key is a key as well."""
    if len({x.shard for x in tree}) != len(tree) or any(x.weight <= 0 for x in tree):
        raise ValueError("shards differ and weigh more than nothing")
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        racks.setdefault(x.region, {})
        racks[x.region][x.rack] = racks[x.region].get(x.rack, 0.0) + x.weight
        leaves.setdefault((x.region, x.rack), []).append((x.shard, x.weight))
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    region = _winner(key, "region", _children(list(regions.items())), seed)
    by_region = F.create_map(*[y for r, kids in sorted(racks.items()) for y in (F.lit(r).cast("int"), _children(list(kids.items())))])
    by_rack = F.create_map(*[y for (r, k), kids in sorted(leaves.items()) for y in (F.lit(f"{r}/{k}"), _children(kids))])
    rack = lambda region: _winner(F.concat_ws("/", key, region), "rack", F.element_at(by_region, region), seed)
    shard = lambda region, rack: _winner(F.concat_ws("/", key, region, rack), "shard", F.element_at(by_rack, F.concat_ws("/", region, rack)), seed)
    return region, rack, shard


def assign(df: DataFrame, key: str, tree: list[Leaf], prefix: str = "", seed: int = SEED) -> DataFrame:
    """df with the columns region, rack and shard, each with the prefix."""
    region, rack, shard = place(F.col(key), tree, seed)
    return (
        df.withColumn(f"{prefix}region", region)
        .withColumn(f"{prefix}rack", rack(F.col(f"{prefix}region")))
        .withColumn(f"{prefix}shard", shard(F.col(f"{prefix}region"), F.col(f"{prefix}rack")))
    )


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard may hold any share of the rows, so it is cut into hash buckets that are
    numbered apart; a bucket's offset is the count of the buckets before it, from a
    table of shards times buckets rows. Rows that are equal in all columns are counted
    first, numbered as one and repeated at the end. `order` names columns that tell
    different rows of a shard apart. Slots depend on the rows only."""
    names = df.columns
    counted = df.select(F.struct("*").alias("row"), F.col(shard).alias("of"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    counted = counted.groupBy("of", *keys, "row").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.pmod(F.xxhash64(*keys, F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy("of", "at").agg(F.sum("n").alias("n"))
    offsets = offsets.select(F.col("of").alias("b_of"), F.col("at").alias("b_at"), F.coalesce(F.sum("n").over(before(Window.partitionBy("of").orderBy("at"))), F.lit(0)).alias("offset"))
    within = before(Window.partitionBy("of", "at").orderBy(*keys))
    placed = counted.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, F.col("of").eqNullSafe(F.col("b_of")) & (F.col("at") == F.col("b_at")))
    pieces = placed.select("row", "n", (F.col("offset") + F.col("within")).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    to = F.least(F.col("from") + PIECE, F.col("n")) - 1
    return pieces.select("row", F.explode(F.sequence(F.col("start") + F.col("from"), F.col("start") + to)).alias("slot")).select(*[F.col("row")[c].alias(c) for c in names], F.col("slot").alias(slot))


def shard_documents(df: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Each row's shard out of `shards`, and its shard with one more.

    Law ``key``: key and shard count decide. Null keys are one key, null texts count
    8 bytes and have no crc32, of very long texts size and crc32 only are kept, repeated
    rows share a shard and take slots of their own, of equal draws the smaller name
    wins, an empty table gives no rows, other columns are left out.
    Returns key, size, text_crc32, law, region, rack, shard, slot, grown_shard."""
    tree = uniform_tree(shards)
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text)).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    grown = assign(assign(rows, "doc_id", tree, seed=seed), "doc_id", with_shard(tree), prefix="grown_", seed=seed)
    numbered = with_slots(grown, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")
