"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard.

Equal vectors are one node, which carries its smallest ids: enough for the k nearest,
since ties go to smaller ids, and a vector that a third of all rows share costs one
node. Nodes are dealt to shards by hash; a shard's hierarchical graph is built in one
task, from nodes in a fixed order, and stored as flat neighbour arrays in a row of a
checkpoint. Queries are packed into blocks, which stream past each shard's graph: a
task reads a graph once and holds one block at a time. A query's results of all shards
are merged. Scores are of the original vectors, in double precision; a search whose
worst find still ties with its k-th one is widened, so that ties are decided by id.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm.common import checkpointed, shuffle_partitions

M = 16
EF_BUILD, EF_SEARCH = 80, 128
#: Rows of a shard: as many times the root of the table's rows, between bounds that a
#: task's memory and time give; searches then grow by the root of the rows each, not by
#: the rows. Queries in a block.
ROOT_SHARE, LEAST_ROWS, MOST_ROWS, BLOCK_QUERIES = 32, 4096, 65_536, 512
#: Nodes that are inserted at a time.
INSERTED = 256
#: Differences between similarities in single precision that may be ties.
SINGLE = 1e-5
SEED = 3
#: No id: a node has fewer rows than a result.
NOBODY = np.iinfo(np.int64).min


class Graph:
    """Unit vectors, and for each level the neighbours of its nodes as one flat array
    with their numbers; entry is a node of the highest level."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray], counts: list[np.ndarray], entry: int):
        self.vectors, self.neighbours, self.counts, self.entry = vectors, neighbours, counts, entry
        self.seen = np.zeros(len(vectors), np.int64)
        self.stamp = 0

    def nearest(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """About the ef nearest nodes (similarity, node), best first."""
        at = self.entry
        for level in range(len(self.neighbours) - 1, 0, -1):
            at = self._descend(q, at, level)
        return sorted(self._layer(q, [at], ef, 0), reverse=True)

    def _descend(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.vectors[at] @ q)
        while True:
            near = self.neighbours[level][at, : self.counts[level][at]]
            if not len(near):
                return at
            sims = self.vectors[near] @ q
            i = int(sims.argmax())
            if sims[i] <= best:
                return at
            best, at = float(sims[i]), int(near[i])

    def _layer(self, q: np.ndarray, entries: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        self.stamp += 1
        stamp, seen, vectors, neighbours, counts = self.stamp, self.seen, self.vectors, self.neighbours[level], self.counts[level]
        seen[entries] = stamp
        found = [(float(vectors[e] @ q), e) for e in entries]
        todo = [(-s, e) for s, e in found]
        heapq.heapify(found)
        heapq.heapify(todo)
        while todo:
            s, c = heapq.heappop(todo)
            if len(found) >= ef and -s < found[0][0]:
                break
            near = neighbours[c, : counts[c]]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = vectors[near] @ q
            if len(found) >= ef:
                better = sims > found[0][0]
                near, sims = near[better], sims[better]
            for x, n in zip(sims.tolist(), near.tolist(), strict=True):
                if len(found) < ef:
                    heapq.heappush(found, (x, n))
                    heapq.heappush(todo, (-x, n))
                elif x > found[0][0]:
                    heapq.heapreplace(found, (x, n))
                    heapq.heappush(todo, (-x, n))
        return found


def _diverse(among: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For rows of candidates (best first, -inf is none) a mask of up to `most` of each:
    those nearer to the row's node than to any chosen before, then the best of the others."""
    real = np.isfinite(sims)
    blocked = ~real
    chosen = np.zeros(sims.shape, bool)
    count = np.zeros(len(sims), np.int32)
    for i in range(sims.shape[1]):
        take = ~blocked[:, i] & (count < most)
        if take.any():
            chosen[:, i] = take
            count += take
            blocked |= take[:, None] & (among[:, i] > sims)
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.zeros(sims.shape, bool)
    np.put_along_axis(out, order, np.take_along_axis(real, order, axis=1), axis=1)
    return out


def _chosen(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    near = vectors[ids]
    return _diverse(near @ near.transpose(0, 2, 1), sims, most)


def _level(vectors: np.ndarray, m: int, keep: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """One level of the graph over its vectors in order of insertion: each is linked with
    diverse ones of the ef nearest before it, both ways; a list of more than `keep` is
    thinned by the same rule. Those before come from products of blocks of rows, which a
    shard's size bounds, so that an insertion's search misses none."""
    n = len(vectors)
    sources: list[np.ndarray] = []
    targets: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    for start in range(0, n, INSERTED):
        end = min(n, start + INSERTED)
        sims = vectors[start:end] @ vectors[:end].T
        sims[np.arange(end) >= np.arange(start, end)[:, None]] = -np.inf
        width = min(ef, end)
        ids = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < end else np.broadcast_to(np.arange(end), sims.shape)
        best = np.take_along_axis(sims, ids, axis=1)
        order = np.argsort(-best, axis=1, kind="stable")
        ids, best = np.take_along_axis(ids, order, axis=1), np.take_along_axis(best, order, axis=1)
        row, at = np.nonzero(_chosen(vectors, ids, best, m))
        sources.append(row + start)
        targets.append(ids[row, at])
        weights.append(best[row, at])
    forward, back, weight = np.concatenate(sources), np.concatenate(targets), np.concatenate(weights)
    x, y, w = np.concatenate([forward, back]), np.concatenate([back, forward]), np.concatenate([weight, weight])
    own = np.arange(len(x)) < len(forward)
    # a node's own links come first, then those of later nodes, the nearest first
    order = np.lexsort((-w, ~own, x))
    x, y, w = x[order], y[order], w[order]
    count = np.bincount(x, minlength=n)
    place = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    # of a hub's links, those of ef later nodes are weighed
    few = place < m + ef
    x, y, w, place = x[few], y[few], w[few], place[few]
    count = np.bincount(x, minlength=n)
    neighbours = np.full((n, keep), -1, np.int32)
    fits = (count <= keep)[x]
    neighbours[x[fits], place[fits]] = y[fits]
    full = np.flatnonzero(count > keep)
    firsts = np.cumsum(count) - count
    for start in range(0, len(full), INSERTED):
        nodes = full[start : start + INSERTED]
        width = int(count[nodes].max())
        at = firsts[nodes][:, None] + np.arange(width)
        there = np.arange(width) < count[nodes][:, None]
        at = np.where(there, at, 0)
        ids, sims = np.where(there, y[at], 0), np.where(there, w[at], -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        row, col = np.nonzero(_chosen(vectors, ids, sims, keep))
        number = np.bincount(row, minlength=len(nodes))
        neighbours[nodes[row], np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)] = ids[row, col]
    return neighbours, np.minimum(count, keep).astype(np.int32)


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = SEED) -> Graph:
    """The graph of unit vectors, inserted in the order given."""
    n = len(vectors)
    levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int), 12)
    neighbours, counts = [], []
    for level in range(int(levels.max(initial=0)) + 1):
        members = np.flatnonzero(levels >= level)
        near, count = _level(vectors[members], m, 2 * m if level == 0 else m, ef)
        if level:
            flat, number = np.full((n, m), -1, np.int32), np.zeros(n, np.int32)
            flat[members], number[members] = np.where(near >= 0, members[near], -1), count
            near, count = flat, number
        neighbours.append(near)
        counts.append(count)
    return Graph(vectors, neighbours, counts, int(levels.argmax()) if n else 0)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two by which their largest component is between a half
    and one: without rounding, and without overflow of squares and products."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _norms(scaled: np.ndarray) -> np.ndarray:
    return np.sqrt((scaled * scaled).sum(axis=1))


def _unit(scaled: np.ndarray) -> np.ndarray:
    return (scaled / _norms(scaled)[:, None]).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def shard_rows_of(total: int) -> int:
    return max(LEAST_ROWS, min(MOST_ROWS, ROOT_SHARE * math.isqrt(total)))


def nearest_ids(graph: Graph, vectors: np.ndarray, norms: np.ndarray, members: np.ndarray, q: np.ndarray, number: int, k: int, ef: int) -> list[tuple[float, int]]:
    """The k best (score, id) of a graph for a scaled query, but for the id `number`:
    larger scores first, then smaller ids. Sums go over each row apart from the others,
    so that equal vectors score alike wherever they are."""
    q_norm = _norms(q[None])[0]
    unit = (q / q_norm).astype(np.float32)
    while True:
        found = graph.nearest(unit, ef)
        tied = len(found) > k and found[-1][0] >= found[k][0] - SINGLE
        if not tied or len(found) < ef:
            break
        ef *= 4
    near = np.array([n for _, n in found])
    scores = (vectors[near] * q).sum(axis=1) / (norms[near] * q_norm)
    if len(near) > k + 1:  # one node may hold the query's own id only
        keep = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        near, scores = near[keep], scores[keep]
    own = sorted((-s, int(v)) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for v in members[n] if v != number and v != NOBODY)
    return [(-s, v) for s, v in own[:k]]


def search(
    df: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5,
    shard_rows: int | None = None, block_queries: int = BLOCK_QUERIES, ef: int = EF_SEARCH, query_share: float = 0.02,
) -> DataFrame:
    """The k rows nearest to each row that `queries` selects, but for the row itself.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, however large or small the others are; vectors of different lengths are not
    compared; fewer candidates give fewer rows; equal scores go to the smaller id; rows
    that repeat an id count once for each vector; a null id is no candidate and no query;
    an empty table gives no rows; other columns are left out. Returns query_id, rank
    (from 1), vec_id, score."""
    kind = df.select(vector).schema[0].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"), queries.alias("is_query"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    total = df.count()
    shards = max(1, -(-total // (shard_rows or shard_rows_of(total))))
    blocks = max(1, int(total * query_share) // block_queries)

    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = (
        rows.select("v", "vec_id").distinct().withColumn("nth", first).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    )

    def build_shard(group: pa.Table) -> pa.Table:
        vectors = _scaled(_matrix(group["v"], np.float64))
        ids = group["ids"].combine_chunks().to_pylist()
        order = np.argsort(np.array([x[0] for x in ids]), kind="stable")
        vectors = vectors[order]
        graph = build(_unit(vectors))
        members = np.full((len(vectors), k + 1), NOBODY, np.int64)
        for i, x in enumerate(ids):
            members[i, : len(x)] = x
        out = io.BytesIO()
        flat = {f"n{i}": a for i, a in enumerate(graph.neighbours)} | {f"c{i}": a for i, a in enumerate(graph.counts)}
        np.savez(out, vectors=vectors, members=members[order], entry=graph.entry, **flat)
        return pa.table({"dim": group["dim"][:1], "shard": group["shard"][:1], "graph": pa.array([out.getvalue()], pa.binary())})

    graphs = checkpointed(nodes.groupBy("dim", "shard").applyInArrow(build_shard, "dim int, shard int, graph binary"))

    asked = F.collect_list(F.struct("vec_id", "v")).alias("asked")
    packed = (
        rows.where("is_query").select("vec_id", "v").distinct().withColumn("dim", F.size("v"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block").agg(asked)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    stored = graphs.select("dim", "shard", F.lit(-1).alias("block"), F.lit(None).cast(packed.schema["asked"].dataType).alias("asked"), "graph")
    # each graph before the blocks of its shard; blocks are dealt apart from each other by no more than their shard
    met = (
        stored.unionByName(packed.select("dim", "shard", "block", "asked", F.lit(None).cast("binary").alias("graph")))
        .repartition(max(shuffle_partitions(df.sparkSession), min(shards, 4096)), "dim", "shard").sortWithinPartitions("dim", "shard", "block")
    )

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(len(batch)):
                of = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if batch.column(4)[i].is_valid:
                    read = np.load(io.BytesIO(batch.column(4)[i].as_buffer()))
                    levels = sum(1 for f in read.files if f[0] == "n")
                    vectors, members = read["vectors"], read["members"]
                    graph = Graph(_unit(vectors), [read[f"n{x}"] for x in range(levels)], [read[f"c{x}"] for x in range(levels)], int(read["entry"]))
                    norms, held = _norms(vectors), of
                elif of == held:
                    queried = batch.column(3)[i].values
                    wanted = _scaled(_matrix(queried.field("v"), np.float64))
                    out = [(number, v, s) for number, q in zip(queried.field("vec_id").to_pylist(), wanted, strict=True) for s, v in nearest_ids(graph, vectors, norms, members, q, number, k, ef)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(search_blocks, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
