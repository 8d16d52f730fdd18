"""SimHash near-duplicates by BK-trees.

Fingerprints that differ in at most two bits agree in at least six of eight bytes, so
each distinct fingerprint goes to one shard for each of the 28 choices of six bytes.
A shard's fingerprints differ in the two other bytes only: it holds 65,536 at most,
whatever the corpus, since copies have been collapsed. For each shard a BK-tree is built
(children keyed by integer Hamming distance to the parent); every fingerprint is
searched for in it, following edges within the radius only. Trees of many shards are
flat arrays that are built and searched together, a level at a time. Two fingerprints within
the radius share a shard, so no link is lost; a shard returns a spanning star of each
of its linked sets instead of all pairs, which is as good for components. The trees
stay where their shard is, with its queries: a broadcast of all trees would grow with
the corpus.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.llm.common import checkpointed, map_slices, shuffle_partitions
from streetlens.llm.components import connected

RADIUS = 2
WORDS = 3
SEED = 42
BLOCKS = 8
#: Shingles of a text whose bits are counted at a time.
COUNTED = 1 << 15
#: Pairs of query and node that a search holds at a time.
FRONTIER = 1 << 20


def fingerprint(text: str | None, words: int = WORDS) -> bytes:
    """The 64 bits, first byte highest, of a text's word shingles (repeats count)."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_digest(joined, SEED)
    ends = list(accumulate(map(len, found), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    spans = list(zip(starts, ends[words - 1 :], strict=False))
    return majority((b"".join([digest(joined[a:b], SEED) for a, b in spans[i : i + COUNTED]]) for i in range(0, len(spans), COUNTED)), len(spans))


def majority(runs: Iterable[bytes], n: int) -> bytes:
    """The bits that over half of n hashes have, which come in runs of 8 bytes each."""
    ones = np.zeros(64, np.int64)
    for hashes in runs:
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and fp (the 64 bits as a signed long)."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))

    def per_slice():
        def run(batch: pa.RecordBatch) -> dict:
            packed = b"".join(map(fingerprint, batch.column(1).to_pylist()))
            return {"doc_id": batch.column(0), "text_key": batch.column(2), "fp": pa.array(np.frombuffer(packed, ">i8").astype("<i8"))}

        return run

    return map_slices(rows, per_slice, "doc_id long, text_key long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKForest:
    """BK-trees over the distinct unsigned integers of shards, one tree for each: a table
    of node by distance to child, or -1. A shard's first value is its root."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values = values
        firsts = np.cumsum(sizes) - sizes
        self.root = np.repeat(firsts, sizes)
        self.child = np.full((len(values), 65), -1, np.int32)
        flat = self.child.reshape(-1)
        item = np.delete(np.arange(len(values)), firsts)
        at = self.root[item]
        while len(item):
            slot = at * 65 + np.bitwise_count(values[item] ^ values[at])
            _, first = np.unique(slot, return_index=True)
            flat[slot[first]] = item[first]
            rest = np.ones(len(item), bool)
            rest[first] = False
            item, at = item[rest], flat[slot[rest]].astype(np.int64)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (value, earlier value of its shard) within the radius, by number."""
        values, steps = self.values, np.arange(-radius, radius + 1)
        # a search holds at most as many nodes as its tree has
        load = np.cumsum(np.bincount(self.root, minlength=len(values))[self.root]) // FRONTIER
        for q in np.split(np.arange(len(values)), np.flatnonzero(np.diff(load)) + 1):
            at = self.root[q]
            while len(q):
                d = np.bitwise_count(values[q] ^ values[at]).astype(np.int64)
                near = (d <= radius) & (at < q)
                if near.any():
                    yield q[near], at[near]
                edges = d[:, None] + steps
                nxt = np.where((edges >= 0) & (edges <= 64), self.child[at[:, None], np.clip(edges, 0, 64)], -1)
                keep = nxt >= 0
                q, at = np.repeat(q, keep.sum(axis=1)), nxt[keep].astype(np.int64)


def link_shards(shards: list[list[int]], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Stars (member, smallest) of the sets that links within the radius form in shards
    of distinct signed longs."""
    values = np.array([v for s in shards for v in sorted(s)], np.int64)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in BKForest(values.view(np.uint64), np.array([len(s) for s in shards if s])).links(radius):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(int(values[i]), int(values[r])) for i in range(len(values)) if (r := root(i)) != i]


def link(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    return link_shards([values], radius)


def shard_masks(radius: int = RADIUS) -> list[int]:
    """Signed masks of the bytes that fingerprints of a shard have in common."""
    masks = []
    for free in itertools.combinations(range(BLOCKS), radius):
        mask = sum(0xFF << (8 * b) for b in range(BLOCKS) if b not in free)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (u, v) of a table of distinct fingerprints (fp)."""
    masks = F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(shard_masks(radius))])
    shards = (
        fps.repartition(shuffle_partitions(fps.sparkSession), "fp")  # dealt in full width before there are 28 times as many
        .select("fp", F.explode(masks).alias("m"))
        .select("fp", F.col("m.i").alias("i"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("common"))
        .groupBy("i", "common").agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars = link_shards(batch.column(0).to_pylist(), radius)
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return shards.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every row's component of fingerprints linked within the radius.

    Null, empty and white texts have fingerprint 0, linked like any other; texts of
    fewer words than a shingle are one shingle; very long texts are counted in runs; a
    bit that is set in just half of the hashes is 0; a component's id is the smallest; repeated rows and equal texts share a
    component; a null doc_id counts as a component's id only if it has no other; an
    empty table gives no rows; other columns are left out.
    Returns doc_id, text_key, fp, component_id and kept (the doc_id and text_key of the
    row that stands for the component)."""
    rows = checkpointed(fingerprints(df, doc_id=doc_id, text=text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    distinct = rows.groupBy("fp").agg(first.alias("first"))
    stars = connected(near_links(distinct.select("fp"), radius))
    labelled = distinct.join(stars, F.col("fp") == F.col("u"), "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    components = labelled.groupBy("root").agg(F.min("first").alias("kept")).withColumnRenamed("root", "of")
    found = labelled.join(components, F.col("root") == F.col("of")).select(F.col("fp").alias("at"), F.struct("kept.doc_id", "kept.text_key").alias("kept"))
    return rows.join(found, F.col("fp") == F.col("at")).select("doc_id", "text_key", "fp", F.col("kept.doc_id").alias("component_id"), "kept")


def only(df: DataFrame, kept: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df for each doc_id and text_key of kept. Rows travel in a struct, so
    that their columns may have any names."""
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit("\0null"))
    keyed = df.select(F.struct("*").alias("row"), F.xxhash64(text).alias("text_key"), as_text(F.col(doc_id)).alias("doc_key"))
    kept = kept.select(as_text(F.col("doc_id")).alias("doc_key"), "text_key")
    return keyed.join(kept, ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"]).select("row.*")


def deduplicate(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """df with one row of each component: the one with the smallest doc_id."""
    return only(df, near_duplicates(df, doc_id=doc_id, text=text, radius=radius).select("kept.*").distinct(), doc_id=doc_id, text=text)
