from __future__ import annotations

import numpy as np

import corpus_pipeline
from test_near_copies import kept_by_force
from streetlens.llm import langid, mixing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "tokens"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["toxicity"](spark, docs, sf)
    scorer = toxicity.Scorer(toxicity.train(*toxicity.training_rows(docs, labels)))
    every = docs.collect()
    scores = scorer.score([r.text or "" for r in every])
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r, s in zip(every, scores, strict=True) if s < toxicity.THRESHOLD)

    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "123", "en", "src1", 3), (-3, "日本語", "en", "src1", 3)], docs.schema)
    told = stage["language"](spark, docs.unionByName(odd), sf)
    assert told.columns == COLUMNS and {r.doc_id for r in told.collect()} == {r.doc_id for r in every}

    single = stage["near_duplicates"](spark, docs, sf)
    assert single.columns == COLUMNS and sorted(r.doc_id for r in single.collect()) == kept_by_force([(r.doc_id, r.text) for r in every])

    mixed = stage["mixing"](spark, docs, sf)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert mixed.columns == COLUMNS and copies == {i: c for i, (t, s) in taken.items() if s and (c := int(t / s + 0.5))}

    coded = stage["tokens"](spark, docs, sf).collect()
    assert len(coded) == len(every) and all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in coded)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and rows.count() > 50


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert langid.training_rows(docs) == {}
