"""What training leaves in the driver."""

from __future__ import annotations

import re
import time
from pathlib import Path

from streetlens.llm import toxicity
from streetlens.sources.session import collected


def held(pid: int | str = "self") -> float:
    """MB of a process, this one if not named, without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_training_gives_back_what_it_took(monkeypatch):
    texts = [" ".join(f"w{i}x{j * 7919 % 99991}" for j in range(400)) for i in range(300)]
    toxic = [i % 3 == 0 for i in range(300)]
    monkeypatch.setattr(toxicity, "UPDATES", 8)
    toxicity.train(texts[:30], toxic[:30])  # what is loaded once
    calls = []
    monkeypatch.setattr(toxicity, "given_back", lambda f=toxicity.given_back: (f(), calls.append(held())))
    before = held()
    toxicity.train(texts, toxic)
    assert len(calls) >= 2 and calls[-1] < max(before + 40, max(calls[:-1]))


def test_spark_s_side_is_small_while_a_network_is_trained(spark, sf, monkeypatch):
    cleaned = []
    monkeypatch.setattr(toxicity, "collected", cleaned.append)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts, labels = toxicity.training_rows(docs, labels.select("doc_id", "toxic"))
    assert len(texts) == len(labels) and cleaned == [spark]


def test_rows_of_n_grams_take_two_bytes():
    words = ["alpha", "beta", "gamma-delta", "日本語のテキスト"] * 3
    rows, grams = toxicity._features(words, at_once=5)
    want_rows, want = toxicity.word_features(words)
    assert (rows == want_rows).all() and all(at.itemsize == 2 for at, _ in grams)
    assert all((a == x).all() and (b == y).all() for (a, b), (x, y) in zip(grams, want, strict=True))


def test_java_gives_back_what_it_has_freed_outside_of_its_heap(spark):
    jvm = spark.sparkContext._jvm
    pid, kept, dropped = jvm.java.lang.ProcessHandle.current().pid(), jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for _ in range(2):
        collected(spark)
    for i in range(3000):  # those that are kept stand between those that are not
        (kept if i % 30 == 0 else dropped).add(jvm.java.nio.ByteBuffer.allocateDirect(1 << 16))
    full = held(pid)
    del dropped
    for _ in range(3):
        collected(spark)
        time.sleep(0.5)
    assert full - held(pid) > 100
