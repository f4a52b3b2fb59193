"""A training-data pipeline over `documents`: each stage takes what the one before it kept.

Null and empty texts pass every filter (no n-grams, no shingles, no secrets) and are packed
as the end id alone; a null doc_id is never a near-duplicate of anything. Repeated rows are
decided alike, but for near-duplicates, where rows of one doc_id are one document. Further
columns pass through. Empty tables give no rows; without labels nothing is rejected by the
first stage, without benchmark items nothing by the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quill.llm.common import intermediates, materialize, table, without
from quill.llm.containment import contained_items
from quill.llm.importance import importance_resample
from quill.llm.minhash_dedup import near_duplicates
from quill.llm.packing import pack_documents
from quill.llm.secret_scan import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go, toxic ones among them."""
    return without(docs, importance_resample(docs, table(spark, sf_dir, "labels")).filter("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. Links are those of similarity 0.8 or more, for which 15 of 32 coordinates must agree; rows of one doc_id are one document."""
    return without(docs, near_duplicates(docs, percent=80, matches=15).filter("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's shingles go."""
    return without(docs, contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "row_key"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Tokenizing and seeded sampling are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with intermediates(spark, name):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
