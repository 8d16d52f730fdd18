"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.llm import bottom_k, byte_bpe, extraction, hnsw, langid, licences, mixing, sharding, simhash, toxicity
from streetlens.llm.common import table

SHARDS = 24


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op3_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.train(*toxicity.training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return toxicity.score(docs, network)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.Filters.fit(langid.training_rows(docs)))


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottom_k.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("sketch").alias("fingerprint"),
        F.col("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", "n_shingles", "contained_edited",
    )


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return licences.scan(docs.withColumn("path", licences.document_path()))


QUERIES = {
    "op1_hnsw": op1_hnsw,
    "op2_hash_tree": op2_hash_tree,
    "op3_water_filling": op3_water_filling,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_line_blocks": op8_line_blocks,
    "op9_bottom_k": op9_bottom_k,
    "op10_licences": op10_licences,
}

ORACLES = {
    "op10_licences": licences.oracle(),
    # the level by sums over the sources below each one, as the operator's prefix sums
    "op3_water_filling": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''))) AS o
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS i, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT a.i, (a.total - coalesce((SELECT sum(b.source_size * 3) FROM ranked b WHERE b.i < a.i), 0)) / (SELECT sum(b.weight) FROM ranked b WHERE b.i >= a.i) AS level,
         a.weight, a.source_size FROM ranked a),
water AS (SELECT coalesce((SELECT level FROM levels WHERE level * weight <= source_size * 3 ORDER BY i LIMIT 1), 0.0) AS level),
goals AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), level * weight) AS target FROM ranked, water),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS words,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - start)) END AS taken
FROM placed""",
}
