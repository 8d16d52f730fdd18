from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetlens.llm import hnsw, mixing, sharding


def exact(ids, vectors, queries, k):
    v = np.array(vectors, float)
    n = np.linalg.norm(v, axis=1)
    out = {}
    for q in queries:
        i = ids.index(q)
        s = v @ v[i] / (n * n[i])
        out[q] = sorted((-x, j) for x, j, p in zip(s, ids, range(len(ids)), strict=True) if j != q)[:k]
    return out


def test_graph_recall():
    rng = np.random.default_rng(1)
    v = hnsw._unit(rng.normal(size=(2000, 32)))
    graph = hnsw.build(v)
    hit = 0
    for q in range(0, 2000, 40):
        true = set(np.argsort(-(v @ v[q]))[:6])
        hit += len(true & {n for _, n in graph.nearest(v[q], 128)[:6]})
    assert hit / (50 * 6) >= 0.95


def test_search_matches_brute_force_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:140] = v[0]  # one vector that many rows share
    rows = [(i, v[i].tolist(), "x") for i in range(300)]
    bad = [(1000, None, ""), (1050, [0.0] * 8, ""), (1100, [float("nan")] * 8, ""), (1150, [float("inf")] + [0.0] * 7, ""), (1200, [], ""), (None, [1.0] * 8, ""), (1250, [None] + [1.0] * 7, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    got = hnsw.search(df, F.col("vec_id") % 50 == 0, shard_rows=100, block_queries=2).collect()
    want = exact(list(range(300)), v, [q for q in range(0, 300, 50)], 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(want)
    found = 0
    for q, rs in by.items():
        assert [x for x, _, _ in sorted(rs)] == [1, 2, 3, 4, 5]
        found += len({j for _, j, _ in rs} & {j for _, j in want[q]})
        for (_, _, s), (w, _) in zip(sorted(rs), want[q], strict=True):
            assert abs(s + w) < 1e-9
    assert found >= 0.95 * 5 * len(want)
    assert [j for _, j, _ in sorted(by[0])] == [100, 101, 102, 103, 104]  # ties go to smaller ids


def plain_nearest(rows, k=5):
    """By fractions of exact squares and products: cosine as sign and square."""
    from fractions import Fraction

    out = {}
    for i, a in rows:
        if i % 50 == 0:
            scored = []
            for j, b in rows:
                if j != i:
                    dot = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
                    square = dot * dot / (sum(Fraction(x) ** 2 for x in a) * sum(Fraction(x) ** 2 for x in b))
                    scored.append((-square if dot > 0 else square, j))
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [8, 1000])
def test_search_ties_and_norms(spark, shard_rows):
    base = [1.0, 2.0, 4.0, 0.0]
    rows = [(i, [x * 2.0**i for x in base]) for i in range(20)]  # multiples of one vector, in several shards
    # unlike vectors of one cosine to the first axis
    rows += [(100, [1.0, 0.0, 0.0, 0.0]), *((101 + i, [3.0 * 2.0**i, *np.roll([4.0, 0.0, 0.0], i % 3) * (-1.0) ** i * 2.0**i]) for i in range(24))]
    rows += [(150, [1e-200, 2e-200, 4e-200, 0.0]), (151, [1e200, 2e200, 4e200, 0.0]), (200, [5e-324, 0.0, 0.0, 0.0]), (201, [1.7e308, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    by = {}
    got = hnsw.search(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_queries=2).collect()
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert -1.000001 <= r.score <= 1.000001
    assert by == plain_nearest([(i, v) for i, v in rows]) and by[0] == [1, 2, 3, 4, 5]


def test_search_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.search(empty, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in hnsw.search(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]


DOCS = "doc_id long, text string, source string, shard string, size int"


def docs(spark, n=600):
    rows = [(i, None if i % 37 == 0 else "word " * (i % 11), f"s{i % 5}" if i % 9 else None, "clash", 1) for i in range(n)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "a b", "s0", "", 2), (None, None, None, None, None)], DOCS)


def test_shards(spark):
    got = sharding.shard_documents(docs(spark), 24).collect()
    assert len(got) == 604
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    one = next(r for r in got if r.doc_id == 5)
    assert one.size == len(b"word " * 5) + 8 and one.text_crc32 == zlib.crc32(b"word " * 5)
    assert all(r.size == 8 and r.text_crc32 is None for r in got if r.doc_id == 37)
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    moved = sum(r.grown_shard != r.shard for r in got)
    assert 5 < moved < 60  # about one in 25
    assert sharding.shard_documents(docs(spark).limit(0), 24).count() == 0


def test_weights_and_movement(spark):
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 0, 1, 3.0), sharding.Leaf(0, 1, 2, 2.0), sharding.Leaf(1, 0, 3, 2.0)]
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.assign(ids, "doc_id", tree).collect()}
    share = Counter(before.values())
    for leaf in tree:
        assert abs(share[leaf.shard] / 8000 - leaf.weight / 8) < 0.03
    # more weight in a rack moves rows into its region only
    heavier = [*tree[:2], sharding.Leaf(0, 1, 2, 4.0), tree[3]]
    after = {r.doc_id: r.shard for r in sharding.assign(ids, "doc_id", heavier).collect()}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b in (0, 1, 2) for _, b in moved)
    assert not any(a == 2 for a, _ in moved)


def filled(sizes, weights, cap=3.0):
    """Targets by rounds."""
    total, open_, target = float(sum(sizes.values())), set(sizes), {}
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > cap * sizes[s]]
        if not over:
            target |= {s: left * weights[s] / w for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, None: 5}, {"a": 7}, {"a": 0, "b": 3}, {"x": 100, "y": 100, "z": 100, "zz": 1}])
def test_water_filling(spark, sizes):
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = filled(sizes, weights)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == 604
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.source, [0, r.target, 0, r.source_size])
        t[0] += r.taken
        t[2] += r.size
    assert all(abs(taken - target) <= 1 and size == stated for taken, target, size, stated in by.values())
    again = mixing.mix(docs(spark).repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    rows = mixing.repeated(mixing.mix(docs(spark), carry=True))
    assert rows.columns == docs(spark).columns  # one of them named size, as the mix's own
    words = sum(len((r.text or "").split()) for r in rows.collect())
    assert abs(words - sum(r.taken for r in got)) <= 11 * len(by)
