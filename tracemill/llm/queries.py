"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import (
    bpe, counts, exact, licenses, near, negatives, packing, pages, passages, quality, quotes, repair, shards,
)
from tracemill.llm.common import documents
from tracemill.session import fresh_path

VOCABULARY = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(documents(spark, sf_dir))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encode_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return packing.pack_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    cache = fresh_path(spark, "token-counts")
    return counts.count_tokens(documents(spark, sf_dir), cache, path, public_tokenizers.PATTERN)


def op8_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return passages.remove_passages(documents(spark, sf_dir), [F.col("n_words"), F.col("n_removed"), digest])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_rules, op2_vector_shards, op3_page_text, op4_quote_threads, op5_bpe_transducer,
        op6_best_fit, op7_token_counts, op8_exact_copies, op9_license_scan, op10_near_copies,
        op11_repeated_passages, op12_conversation_repair, op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}
