"""A corpus pipeline over ``documents``: quality, near-duplicates, benchmark passages, secrets, mixing.

Each stage takes what the one before kept, written as Parquet and read again. The first three drop documents, the
fourth rewrites texts, the last returns what the mix takes of each document. All but the last return the columns of
``documents``. Null texts and ids, empty and very long texts, ties, repeated rows and empty tables are handled as the
operators tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, mixing, quality, secrets, simhash
from weftline.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier of a low grade than of the highest."""
    return quality.select_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group."""
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edited a little or not."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; every document stays."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each document left."""
    return mixing.mix_sources(docs).documents


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
]

#: SQL can't express the classifier, SimHash or the edit-distance search; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
