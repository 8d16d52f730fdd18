"""Pieces of byte-level BPE that are merged many at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest

from streetlens.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(byte_bpe.default_path()), special_tokens={})


def texts() -> list[str]:
    rng = random.Random(3)
    parts = ["the", "tion", "an", "ed", "é", "ß", "日本", "語", "a", "b", "zz", "q", "0", "17", " ", "  ", "\n", "!", "\U0001f600", "xyzzy"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [*made, "", "a" * 31, "a" * 32, "a" * 33, "ab" * 500, "é" * 16, "日" * 40]


def test_many_merge_as_one_does():
    own = byte_bpe.codec()
    pieces = sorted({p.encode() for t in texts() for p in own.split_of(t).findall(t)} | {b"ab" * n for n in range(1, 17)})
    two = [p for p in pieces if 1 < len(p) <= byte_bpe.SHORT_BYTES and p not in own.ranks]
    got = [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.merge_many(two, own.ones, own.pairs)]
    assert len(two) > 100 and got == [byte_bpe.merge(p, own.ranks) for p in two]
    assert byte_bpe.merge_many([], own.ones, own.pairs) == []


def test_small_vocabularies():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"ca": 258, b"aab": 259}
    ones, pairs = np.arange(256), byte_bpe.Pairs(ranks)
    rng = random.Random(1)
    pieces = [p for p in (bytes(rng.choices(b"abc", k=rng.randint(1, 20))) for _ in range(500)) if len(p) == 1 or p not in ranks]
    got = [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.merge_many(pieces, ones, pairs)]
    assert got == [byte_bpe.merge(p, ranks) for p in pieces]


@pytest.mark.parametrize(("together", "remembered"), [(1 << 16, 1 << 17), (40, 50), (1, 1)])
def test_texts_are_as_in_the_library(library, monkeypatch, together, remembered):
    monkeypatch.setattr(byte_bpe, "TOGETHER", together)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", remembered)
    own = byte_bpe.Codec(byte_bpe.default_path(), library._pat_str)
    alone = []
    monkeypatch.setattr(byte_bpe, "merge", lambda piece, ranks, f=byte_bpe.merge: alone.append(piece) or f(piece, ranks))
    every = texts()
    want = [library.encode_ordinary(t) for t in every]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_texts(every)] == want
    assert all(len(p) > byte_bpe.SHORT_BYTES for p in alone)  # no piece by itself but the long ones
    assert [np.frombuffer(own.encode_long(own.split_of(t).findall(t)), "<u4").tolist() for t in every] == want
