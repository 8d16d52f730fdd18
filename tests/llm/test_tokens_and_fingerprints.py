from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetlens.llm import bottom_k, byte_bpe, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")


def library():
    import tiktoken

    with open(byte_bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "Hello  world\n\n  it's 12 o'clock!!", "é" * 50 + " ñ  x", "a" * 5000, " " * 3000 + "x", "日本語 テキスト 123", "'r 're 's'S <|endoftext|>", "\x1c\x85՘࢏", "x\r\n\t y" * 700]


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 512), (64, 16), (7, 3), (50, 5)])
def test_encode_like_the_library(spark, chunk, overlap):
    own = library()
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, ""), (3, TEXTS[3], ""), (None, "null id " * 30, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.encode(df, chunk_chars=chunk, overlap_chars=overlap, decoded=True).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    back = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted(w[2] for w in want)
    assert byte_bpe.encode(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t'srtvmlde1.,!éß日x- "), max_size=120), st.integers(4, 20), st.integers(1, 8))
def test_stitching_is_splitting(text, chunk, overlap):
    split = byte_bpe.codec().split
    parts = [text[i : i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]
    found = [byte_bpe.chunk_boundaries(split, p, i * chunk, i == len(parts) - 1) for i, p in enumerate(parts)]
    ends = byte_bpe.stitch(split, text, found, chunk)
    assert [text[a:b] for a, b in zip(ends, ends[1:], strict=False)] == split.findall(text)


def test_unicode_classes_are_the_librarys():
    split, own = byte_bpe.codec().split, library()
    text = "".join(f"a{chr(c)}1 " for c in range(0x20, 0x3000, 7) if not 0xD800 <= c < 0xE000)
    pieces = split.findall(text)
    assert "".join(pieces) == text
    assert [x for p in pieces for x in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_a_text_of_the_basic_plane_is_split_alike_without_ranges_behind_it():
    own = byte_bpe.codec()
    basic = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}\n" for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    assert own.split_of(basic) is own.basic_split and own.split_of("plain") is own.basic_split and own.split_of("") is own.basic_split
    assert own.basic_split.findall(basic) == own.split.findall(basic)
    behind = "a\U00010400b \U0001d7ce1 \U0001f600! \uffff\U00010000"
    assert own.split_of(behind) is own.split
    assert b"".join(own.decode(own.encode_pieces(own.split_of(t).findall(t))) for t in (basic, behind)) == (basic + behind).encode()


def plain_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=2):
    """Smallest id of each component, by all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if y < x and (fps[x] ^ fps[y]).bit_count() <= radius:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB \n\t\x1c éÉ"), max_size=60))
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == plain_fingerprint(text)


@pytest.mark.parametrize("n,bits", [(15, 12), (400, 16), (300, 10)])
def test_links_in_a_shard(n, bits):
    rng = np.random.default_rng(n)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ int(x) << 20 for x in rng.integers(0, 1 << bits, n)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = classes({v: v for v in values})
    got = {v: v for v in signed} | dict(simhash.link(signed))
    assert got == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(vocabulary, 400))
    rows = [(i, base if i < 40 else base.replace("w7 ", "w8 ", 1) + f" tail{i % 3}" if i < 80 else " ".join(rng.choice(vocabulary, int(rng.integers(1, 60))))) for i in range(5, 160)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (5, rows[0][1]), (2, base)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = classes(fps)
    assert all(r.component_id == want[r.doc_id] and r.fp & ((1 << 64) - 1) == fps[r.doc_id] for r in got)
    kept = simhash.deduplicate(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "x y z q")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(only_null).collect()) == ["7", "None", "None"]
    assert simhash.deduplicate(only_null).count() == 2


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_sketches_estimate():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    a = " ".join(rng.choice(words, 3000))
    b = a[: len(a) // 2] + " " + " ".join(rng.choice(words, 1500))
    x, y = bottom_k.sketch(a), bottom_k.sketch(b)
    sa, sb = shingles(a), shingles(b)
    assert abs(bottom_k.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.12
    assert abs(bottom_k.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
    assert abs(bottom_k.distinct_count(x) / len(sa) - 1) < 0.25
    left, right = " ".join(a.split()[:1000]), " ".join(a.split()[996:])
    assert np.array_equal(bottom_k.merge(bottom_k.sketch(left), bottom_k.sketch(right)), x)
    assert np.array_equal(bottom_k.from_hex(bottom_k.to_hex(x)), x)
    few = "one two three four five six"
    assert bottom_k.distinct_count(bottom_k.sketch(few)) == 2 and bottom_k.resemblance(bottom_k.sketch(few), bottom_k.sketch("one two three four five")) == 0.5
    empty = bottom_k.sketch(" ")
    assert bottom_k.resemblance(empty, empty) == 1.0 and bottom_k.resemblance(empty, x) == 0.0


def test_fingerprint_documents(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(0, 40))))) for i in rng.permutation(90)]
    rows += [(100, None), (101, "é" * 10), (50, rows[[r[0] for r in rows].index(50)][1]), (None, "null id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int")
    got = bottom_k.fingerprint_documents(df).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1] or ""]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + nxt[:n]
        a, b, c = (bottom_k.sketch(x) for x in (t, changed, nxt))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), bottom_k.to_hex(a), bottom_k.resemblance(a, b), bottom_k.resemblance(a, c)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.sketch, r.near_edited, r.near_next) for r in got), key=key) == sorted(want, key=key)
    assert bottom_k.fingerprint_documents(df.limit(0)).count() == 0
    one = bottom_k.fingerprint_documents(df.where("doc_id = 101")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].n_chars == 10
