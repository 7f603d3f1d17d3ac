"""Corpus pipeline: toxicity, language, near duplicates, mixing and tokenization of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditora.llm import bpe, langid, mixing, ngramjoin, toxicity
from auditora.llm.common import small_arrow_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below their language's threshold by the convolutional classifier (learnt from ``labels``).

    A NULL or empty text gets the score of no words; rows of NULL keys and repeated rows are judged by their text
    alone; an empty table stays empty.
    """
    small_arrow_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the fused evidence identifies; texts without letters are not identified, repeated rows are
    judged alike, an empty table stays empty."""
    small_arrow_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id, NULL last) of each group linked by 5-word shingle similarity of 0.8 or more;
    texts without words are in no group and stay."""
    small_arrow_batches(spark)
    return ngramjoin.keep_one_per_component(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root source weights and globally shuffled; a NULL source is a source, rows equal in key
    draw alike."""
    return mixing.mix_sources(docs, epochs=1.0, temperature=0.5, seed="mix-1")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every copy; NULL and empty texts have no tokens."""
    small_arrow_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_identified), ("near_copies", drop_near_copies), ("mix", mix), ("tokenize", tokenize)]

# A trained classifier stands first, which SQL cannot express; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written below the shared checkpoint folder and read again."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
