"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, search
from .common import table
from .decontam import contaminated
from .langid import language
from .licenses import brute_force_sql, scan_licenses
from .mixing import mix_sources
from .quality import scored
from .secrets import scan_secrets
from .simhash import near_duplicates
from .toxicity import toxicity


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).documents


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(chat.HARD, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(talks.unionByName(hard)))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbours(table(spark, sf_dir, "embeddings"))


def op10_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_simhash_neardup,
        op3_toxicity_cnn,
        op4_benchmark_decontamination,
        op5_chat_formatting,
        op6_license_scan,
        op7_language_id,
        op8_secret_scan,
        op9_exact_topk,
        op10_quality_ordinal,
    )
}

ORACLES: dict[str, str] = {"op5_chat_formatting": chat.ORACLE, "op6_license_scan": brute_force_sql(), "op9_exact_topk": search.ORACLE}
