"""Registered queries of the training-text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    byte_bpe,
    chat,
    checks,
    conversation_repair,
    decontaminate,
    fill_middle,
    html_text,
    language_id,
    language_model,
    near_dedup,
    quality_classifier,
    quality_rules,
    token_counts,
    url_filter,
)
from tidemark.session import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item in it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of at least 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def quality_rules_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def maximal_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the conversations that begin no longer one."""
    return chat.rendered(table(spark, sf_dir, "conversations"))


def unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's pieces and scores, read as a unigram vocabulary."""
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def fill_middle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transformed(table(spark, sf_dir, "documents")))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


def conversation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs, edits and digests of the repair of damaged conversations."""
    return conversation_repair.audited(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


#: The rules that pages are judged by.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

QUERIES: dict[str, Query] = {
    "op1_decontamination": contaminated_documents,
    "op2_quality_rules": quality_rules_of_documents,
    "op3_language_model": language_model_scores,
    "op4_quality_classifier": quality_scores,
    "op5_chat_formatting": maximal_conversations,
    "op6_token_counts": unigram_token_counts,
    "op7_html_extraction": page_texts,
    "op8_near_duplicates": near_duplicate_documents,
    "op9_language_id": document_languages,
    "op10_byte_bpe": byte_bpe_round_trip,
    "op11_fill_middle": fill_middle_digests,
    "op12_url_filter": url_verdicts,
    "op13_conversation_repair": conversation_repairs,
}

CHECKS: dict[str, str] = {
    "op2_quality_rules": checks.QUALITY_RULES,
    "op5_chat_formatting": checks.CHAT,
    "op11_fill_middle": checks.FILL_MIDDLE,
    "op12_url_filter": checks.URL_FILTER,
    "op13_conversation_repair": checks.CONVERSATION_REPAIR,
}
