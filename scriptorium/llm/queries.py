"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, langid, mixing, mtree, passages, quality, secret_scan, simhash, token_counts
from .common import documents


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_query(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_query(documents(spark, sf_dir))


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.topk_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_query(documents(spark, sf_dir))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_secrets that SQL can express."""
    return secret_scan.base_query(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages_query(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


_ALL = (op1_langid, op2_simhash, op3_exact_dedup, op4_mtree, op5_secrets, op6_mixing, op7_byte_bpe, op8_passages, op9_quality, op10_token_counts, secret_base_spans)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op4_mtree": mtree.ORACLE, "secret_base_spans": secret_scan.BASE_ORACLE}
