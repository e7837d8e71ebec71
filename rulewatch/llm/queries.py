"""One query for each operator, over the whole tables, and DuckDB texts where SQL can say it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rulewatch.llm import ann, audit, bpe, brown, counts, decontaminate, language, oracles, quality, repair, shards, simhash, suffixes, windows


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def op1_quality(spark, folder):
    return quality.quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_token_counts(spark, folder):
    return counts.token_counts(read(spark, folder, "documents"), counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op3_language_model(spark, folder):
    return brown.document_scores(read(spark, folder, "documents"))


def op4_decontamination(spark, folder):
    return decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op5_nearest(spark, folder):
    return ann.search(read(spark, folder, "embeddings"))


def op6_simhash(spark, folder):
    return simhash.document_duplicates(read(spark, folder, "documents"))


def op7_shards(spark, folder):
    return shards.document_shards(read(spark, folder, "documents"))


def op8_suffix_dedup(spark, folder):
    return suffixes.digests(read(spark, folder, "documents"))


def op9_substring_dedup(spark, folder):
    return windows.digests(read(spark, folder, "documents"))


def op10_bpe(spark, folder):
    return bpe.digests(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark, folder):
    return audit.filter_audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_conversation_repair(spark, folder):
    return repair.repaired_conversations(read(spark, folder, "conversations"))


def op13_language(spark, folder):
    return language.document_languages(read(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_token_counts, op3_language_model, op4_decontamination, op5_nearest, op6_simhash, op7_shards,
        op8_suffix_dedup, op9_substring_dedup, op10_bpe, op11_filter_audit, op12_conversation_repair, op13_language,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": oracles.FILTER_AUDIT, "op12_conversation_repair": oracles.CONVERSATION_REPAIR}
