"""What Python workers of the pipeline hold."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from streetlens.llm import langid, toxicity


def test_stages_do_without_pandas():
    """Each worker would load it for itself: 27 MB."""
    code = "import sys, corpus_pipeline, pyspark.worker; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_remembered_words_are_kept_as_embedded():
    scorer = toxicity.Scorer(toxicity.Network.start(1))
    assert scorer.table.nbytes <= toxicity.REMEMBERED * 2 * toxicity.SIZE * 4


def test_a_table_that_grew_does_not_stay():
    old, toxicity.REMEMBERED = toxicity.REMEMBERED, 64
    try:
        scorer = toxicity.Scorer(toxicity.Network.start(1))
        few = scorer.score(["a b c"])
        scorer.score([" ".join(map(str, range(1000)))])
        assert scorer.score(["a b c"]) == few
        assert scorer.table.base is None and len(scorer.table) == 64
    finally:
        toxicity.REMEMBERED = old


def test_a_long_text_is_split_some_at_a_time():
    scorer = toxicity.Scorer(toxicity.Network.start(1))
    long = "ab cd\n" * 500_000
    tracemalloc.start()
    scorer.score([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55e6  # its 1,000,000 words as strings are 51 MB and a list of 8 MB


def test_words_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcé日  \x1c\n "), 3000)) + "x" * 200 + " y"
    whole = toxicity.steps(text)
    texts = [text, "", " ", "one", text[::-1]]
    scores = toxicity.Scorer(toxicity.Network.start(9)).score(texts)
    old = toxicity.RUN_CHARS
    try:
        for toxicity.RUN_CHARS in (1, 2, 7, 100, 2999, 10_000):
            assert [w for part in toxicity.spans(text) for w in toxicity.steps(part)] == whole
            got = toxicity._in_runs(toxicity.Scorer(toxicity.Network.start(9)), pa.array(texts))
            assert np.allclose(got, scores, atol=1e-6)
    finally:
        toxicity.RUN_CHARS = old


def test_columns_are_what_the_operators_return(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "日本語 123", "en")], docs.schema)
    docs = docs.unionByName(odd)
    net = toxicity.Network.start(9)
    by = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    found = docs.select("doc_id", toxicity.score_of(docs, net).alias("score")).collect()
    assert len(found) == len(by) and np.allclose([r.score for r in found], [by[r.doc_id] for r in found], atol=1e-6)
    filters = langid.Filters.fit(langid.training_rows(docs))
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, filters).collect()}
    judged = docs.select("doc_id", langid.language_of(docs, filters).alias("l")).collect()
    assert {r.doc_id: (r.l.lang_pred, r.l.score) for r in judged} == told
