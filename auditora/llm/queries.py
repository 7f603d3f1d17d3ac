"""Registered queries of the training-data operators (one per operator) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprints, idstore, langid, licenses, mixing, ngramjoin, substrings, tokencount, topk, toxicity, turnrepair
from .common import scratch_folder, small_arrow_batches
from .sql import DIVERGENCE_SQL, LICENSE_SQL, MIX_SQL, TOPK_SQL, TURN_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_poisson_mix", MIX_SQL)
def poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` repeated to sources' square-root weights and globally shuffled:
    doc_id, source, copy, text_md5 of every copy."""
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"), epochs=1.0, temperature=0.5, seed="mix-1", copy_col="copy")
    return mixed.select("doc_id", "source", "copy", F.md5("text").alias("text_md5"))


@query("op8_minhash_fingerprints")
def minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash of every text and its edited text (128 bins, 8 low-order bits)."""
    return fingerprints.edit_fingerprints(read(spark, sf_dir, "documents"))


@query("op9_license_rules", LICENSE_SQL)
def license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scan of every text of ``documents``."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query("op1_toxicity_cnn")
def toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convolutional toxicity score of every text of ``documents``, learnt from ``labels``."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents`` under the 32k sentencepiece model."""
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_id_store")
def id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents`` written to shards, indexed, and read back by key."""
    return idstore.store_and_read(read(spark, sf_dir, "documents"), scratch_folder(spark, "id-store"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_bpe_automaton")
def bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded by the automaton of the 49k word vocabulary."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_voronoi_topk", TOPK_SQL)
def voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 highest inner products of every 20th vector of ``embeddings`` against all others."""
    return topk.top_products(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, repeated=True)


@query("op7_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose 3-word shingle sets have Jaccard similarity 0.9 or more."""
    return ngramjoin.jaccard_components(read(spark, sf_dir, "documents"), width=3, percent=90)


@query("op5_language_fusion")
def language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page of ``pages`` from text, markup, address and host evidence; the text models
    are learnt from a bounded sample of ``documents``."""
    return langid.identify_pages(read(spark, sf_dir, "pages"), langid.fit(read(spark, sf_dir, "documents")))


@query("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and top terms of every (lang, source) group of ``documents`` by share distance."""
    return divergence.divergence(read(spark, sf_dir, "documents"))


@query("op11_turn_repair", TURN_SQL)
def turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation of ``conversations``."""
    return turnrepair.repair_conversations(read(spark, sf_dir, "conversations"))


@query("op12_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text of ``documents`` that a repeated window of 20 words covers, removed."""
    out = substrings.remove_repeats(read(spark, sf_dir, "documents"), as_hash=True)
    return out.withColumnRenamed("kept", "kept_sha256")
