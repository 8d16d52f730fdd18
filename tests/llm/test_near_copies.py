from __future__ import annotations

from collections import Counter

from corpus_pipeline import near_copies_out
from streetlens.llm import near_copies


def kept_by_force(docs: list[tuple[int, str | None]]) -> list[int]:
    """The smallest id of each component of pairs with a Jaccard of 0.8, over all pairs."""

    def of(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    docs = sorted(docs)
    sets = [of(t) for _, t in docs]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k])
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if n * 5 >= 4 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted({docs[root(i)][0] for i in range(len(docs))})


def test_stage_against_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(r.doc_id for r in near_copies_out(spark, docs, sf).collect())
    assert got == kept_by_force([(r.doc_id, r.text) for r in docs.collect()])


def test_a_changed_word(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:50], "other", *words[51:]]  # 91 of 101 shingles in common
    far = [w + "x" if i % 20 == 7 else w for i, w in enumerate(words)]  # 5 changed: 71 of 121
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (5, "a b"), (4, "A  b"), (7, ""), (6, None), (None, "a b")]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 6]
    assert near_copies.deduplicate(got.limit(0)).count() == 0


def test_a_large_group(spark):
    """One group, all members of which differ from one another."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(200)]
    assert [r.doc_id for r in near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_no_pair_of_a_large_band_is_left_out(spark):
    """30 sets share a band; all but those in one component meet."""
    rows = [(k, (7).to_bytes(8, "big") + b"".join((1000 * k + i).to_bytes(8, "big") for i in range(1, near_copies.BANDS)), k, 100 if k < 29 else 10) for k in range(30)]
    sets = spark.createDataFrame(rows, "set_key long, bands binary, fp long, shingles int")
    stars = spark.createDataFrame([(k, 0) for k in range(1, 12)], "u long, v long")
    first = sets.join(spark.createDataFrame([(0,)], "z int")).select("set_key").crossJoin(sets.select(sets.set_key.alias("v"))).where("set_key = v + 1").selectExpr("set_key as u", "v")
    got = sorted((r.u, r.v) for r in near_copies.missed(sets, stars, first).collect())
    assert got == [(u, v) for u in range(29) for v in range(u) if u >= 12 and u != v + 1]


def test_few_edges_are_joined_in_one_task(spark):
    from streetlens.llm import components

    rng = __import__("random").Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(250)) if a != b]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    few = {(r.u, r.v) for r in components.connected(df).collect()}
    bound, components.FEW = components.FEW, 0
    try:
        assert few == {(r.u, r.v) for r in components.connected(df).collect()} and few
    finally:
        components.FEW = bound


def test_sketches_lose_no_link():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    a = [rng.integers(0, 1 << 62, 400).astype(np.uint64) for _ in range(30)]
    b = [np.concatenate([x[: 400 - 2 * k], rng.integers(0, 1 << 62, 2 * k).astype(np.uint64)]) for k, x in enumerate(a)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(range(30)), pa.array([0] * 30, pa.int32()), *[pa.array(list(map(near_copies.sketch, s)), pa.binary()) for s in (a, b)]], names=["u", "v", "i", "a", "b"])
    kept = set(next(near_copies._possible(iter([rows]))).column(0).to_pylist())
    assert kept >= {k for k in range(30) if near_copies.similar(np.unique(a[k]), np.unique(b[k]))} and len(kept) < 30
    assert near_copies.sketch(np.zeros(300, np.uint64)) == b""
