"""Queries and SQL of the operators of this subpackage: one query for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, fingerprints, mixing, ngram_join, sharding, suffix_dedup, toxicity, url_filter, warc
from .frames import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, its terms and whether it is rejected."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read_table(spark, sf_dir, "pages"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewrite_pages(read_table(spark, sf_dir, "pages"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_blocks(read_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a similar one, with its class and its number of links."""
    return ngram_join.classes(read_table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {"op4_warc_revisits": warc.oracle(), "op10_sharding": sharding.oracle()}
