"""Members of large bands meet inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from streetlens.llm import near_copies


def _side(keys, roots, sets, prefix=""):
    columns = {"i": pa.array([3] * len(keys), pa.int32()), "set_key": pa.array(keys, pa.int64()), "root": pa.array(roots, pa.int64()),
               "shingles": pa.array([len(s) for s in sets], pa.int32()), "sketch": pa.array([near_copies.sketch(s) for s in sets], pa.binary())}
    return pa.table({prefix + k: v for k, v in columns.items()})


def test_pairs_that_meet_are_those_that_may_be_alike(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.concatenate([base[: 300 - k], rng.integers(0, 1 << 62, k + k % 3).astype(np.uint64)]) for k in range(0, 120, 3)]
    sets += [np.full(300, base[0])]  # too many of a counter: no sketch, is kept by its size
    keys, roots = [int(x) for x in rng.integers(-(1 << 60), 1 << 60, len(sets))], [k % 4 for k in range(len(sets))]
    every, outside = _side(keys, roots, sets), _side(keys[::2], roots[::2], sets[::2], "other_")
    want = set()
    for a in range(len(sets)):
        for b in range(0, len(sets), 2):
            less, more = sorted((len(sets[a]), len(sets[b])))
            x, y = (np.frombuffer(near_copies.sketch(sets[k]), np.uint8).astype(int) for k in (a, b))
            common = np.minimum(x, y).sum() if len(x) and len(y) else less
            if roots[a] != roots[b] and less * 5 >= more * 4 and (common * 5 >= 4 * (less + more - common) or not (len(x) and len(y))):
                want.add((max(keys[a], keys[b]), min(keys[a], keys[b])))
    for compared in (1, 50, 1 << 14):
        monkeypatch.setattr(near_copies, "COMPARED", compared)
        got = near_copies._meeting(every, outside)
        assert set(zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)) == want and want
        assert set(got["i"].to_pylist()) == {3}
    for a, b in ((every.slice(0, 0), outside), (every, outside.slice(0, 0))):
        assert near_copies._meeting(a, b).num_rows == 0


def test_pairs_of_a_large_band_are_not_joined(spark):
    """Each member of one band is in a component of its own: all pairs meet, and sketches rule all out."""
    rng = np.random.default_rng(9)
    n = 40
    band = rng.bytes(8 * near_copies.BANDS)
    sets = spark.createDataFrame([(k, bytearray(band), 30) for k in range(n)], "set_key long, bands binary, shingles int")
    texts = spark.createDataFrame([(k, " ".join(f"{k}w{j}" for j in range(34))) for k in range(n)], "set_key long, text string")
    none = spark.createDataFrame([], "u long, v long, n long")
    found = near_copies.missed(sets, none.select("u", "v"), none, texts)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString() and found.count() == 0
    assert near_copies.missed(sets, none.select("u", "v"), none).count() == n * (n - 1) // 2


def test_likeliest_pairs_make_no_row_for_each_end(spark):
    rng = np.random.default_rng(9)
    pairs = sorted({(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 60, (400, 2)) if a != b})
    rows = [(u, v, int(n), u % 11, v % 11) for (u, v), n in zip(pairs, rng.integers(1, 21, len(pairs)), strict=True) if u % 11 != v % 11]
    best: dict[int, tuple] = {}
    for u, v, n, cu, cv in rows:
        for c in (cu, cv):
            best[c] = max(best.get(c, (0,)), (n, u, v))
    found = near_copies._likeliest(spark.createDataFrame(rows, "u long, v long, n long, cu long, cv long"))
    assert sorted(map(tuple, found.collect())) == sorted({(u, v) for _, u, v in best.values()})
    assert "Generate" not in found._jdf.queryExecution().toString()
