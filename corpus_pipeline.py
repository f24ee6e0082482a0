"""From raw documents to tokens: quality rules, quality classifier, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage to the shared folder and goes on from the files, so a lost
executor costs tasks of the stage at hand only.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, decontaminate, near_dedup, quality_classifier, quality_rules
from tidemark.llm.queries import table
from tidemark.session import small_batches, stage

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
#: Words a worker keeps encoded, beside what the stages before have left in its executor.
KEPT_WORDS = 150_000


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the fences of their language and source."""
    return quality_rules.accepted(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more; learnt from all labelled documents outside the held-out fold."""
    known = quality_classifier.measured(table(spark, sf_dir, "documents"))
    return quality_classifier.accepted(docs, quality_classifier.fit(known, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates."""
    small_batches(spark)
    return near_dedup.deduplicated(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    small_batches(spark)
    return byte_bpe.encoded(docs.select("doc_id", "lang", "source", "text"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, KEPT_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and the tokenizer are beyond SQL; the tests follow the stages by brute force instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
CHECKS: dict[str, str] = {}
