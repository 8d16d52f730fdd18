"""Nulls in any column, and extra columns whose names operators use inside."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streetlens.llm import bottom_k, byte_bpe, extraction, hnsw, langid, licences, mixing, sharding, simhash, toxicity

NAMES = tuple(dict.fromkeys((
    "size score fp kept row u v key toxic count draw share path dir w chunk of ids n_tokens rank shard slot law target taken source_size copies copy root first m common "
    "held_out predicted lang_pred label told line is_file x square best at near part place kind edited sketch block asked graph shards nth dim boundaries decoded text_key component_id "
    "__language __doc_key __text_key __id __key __of __order __bucket language doc_key key id run hub band next h first h2 o0 n offset within start from"
).split()))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with a null in each column in turn, twice each, and clashing columns."""
    rows = [(1, "the and of\nReleased under the MIT License.", "en", "src1", 9), (None, "the and of", "en", "src1", 9), (3, None, "en", "src1", 9), (4, "la de que", None, "src1", 9), (5, "la de que", "es", None, 9), (6, "", "es", "src2", None), (None,) * 5]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES])


def test_operators(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int").withColumn("count", F.lit(1))
    assert sharding.shard_documents(odd, 24).count() == n
    assert mixing.mix(odd).count() == n and mixing.mix(odd, carry=True).select("row.*").columns == odd.columns
    assert byte_bpe.encode(odd, decoded=True).count() == n and byte_bpe.encode(odd, chunk_chars=4, overlap_chars=2).count() == n
    assert simhash.near_duplicates(odd).count() == n
    assert langid.identify(odd, langid.Filters.fit(langid.training_rows(odd))).count() == n
    assert toxicity.score(odd, toxicity.train(*toxicity.training_rows(odd, labels))).count() == n
    assert bottom_k.fingerprint_documents(odd).count() == n
    scanned = licences.scan(odd.withColumn("path", F.when(F.col("doc_id") > 1, F.concat_ws("/", F.lit("a"), F.col("doc_id").cast("string")))))
    assert scanned.count() == n
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *[c for c in NAMES])
    assert extraction.extract(pages).count() == n
    vectors = odd.select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("float"), F.col("doc_id").cast("float")).alias("embedding"), *NAMES)
    assert {r.query_id for r in hnsw.search(vectors, F.lit(True)).collect()} == {1, 3, 4, 5}  # 6 has a null component


def test_stages(spark, odd, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.collect()
