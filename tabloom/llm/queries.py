"""Queries op1 to op13 with their SQL counterparts; thin applications of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, gam, html_text, imatch, langid, merkle, mixing, multi_index, rules, simhash, token_scan, url_filter, whitening
from tabloom.llm.blocks import read_documents
from tabloom.llm.sql import SQL  # noqa: F401

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by a separator scan over flat token files."""
    shard = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    return token_scan.corpus_token_counts(read_documents(spark, sf_dir)).select(shard.alias("shard"), "document", "start", "n_tokens")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir))


@query
def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(read_documents(spark, sf_dir))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_documents(spark, sf_dir))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(read_documents(spark, sf_dir)), "base", "base_kept")
    rows = rules.apply_policy(rows, "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


@query
def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_documents(spark, sf_dir))


@query
def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_documents(read_documents(spark, sf_dir))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
