"""A corpus pipeline: toxic documents go, documents in no known language go, one of
each group of near copies stays, sources are mixed to target weights, and what is left
becomes tokens. Counted as a part of the subpackage llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.llm import byte_bpe, langid, mixing, near_copies, toxicity
from streetlens.llm.common import table
from streetlens.sources.session import removed, shared_folder

#: A text with fewer corrected hits than this in its best language is in none of them.
LEAST_LANGUAGE_SCORE = 0.05


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Null and empty texts score 0 and stay;
    very long ones are scored in whole; repeated rows are judged alike; with no labels, or
    those of one kind, all stay; columns go along, whatever their names."""
    network = toxicity.train(*toxicity.training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return docs.where(toxicity.score_of(docs, network) < toxicity.THRESHOLD)


def unknown_language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; all of them where nothing can be learned. Null and
    empty texts, and those without a letter, are in none and go; very long ones are judged
    in whole; repeated rows are judged alike; columns go along, whatever their names."""
    filters = langid.Filters.fit(langid.training_rows(docs))
    if not filters.languages:
        return docs
    judged = docs.select(F.struct("*").alias("row"), langid.language_of(docs, filters).alias("language"))
    return judged.where((F.col("language.lang_pred") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: texts whose sets of
    5-word shingles are alike by 0.8 or more. Null, empty and white texts are alike; very
    long ones are compared in whole; of repeated rows one stays; a null id stays where its
    group has no other; columns go along, whatever their names."""
    return near_copies.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole documents only. Null and empty
    texts have no words and are not taken; null sources are one source; repeated rows are
    documents of their own, ordered by a hash; columns go along, whatever their names."""
    return mixing.repeated(mixing.mix(docs, carry=True))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the bytes they decode to. Null
    and empty texts have no ids; very long ones are encoded in whole; repeated rows stay;
    other columns are left out."""
    coded = byte_bpe.encode(docs, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("language", unknown_language_out),
    ("near_duplicates", near_copies_out),
    ("mixing", mixed),
    ("tokens", tokens),
]
#: SQL can express neither the network nor the pre-tokens; tests run plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written in the shared folder and read again. A stage's
    table goes when the next one is written; the last one is what is returned."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            removed(spark, before)
        before = now
    return docs
