"""What the operators share: reading of documents, folds, rows that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of an array that is exploded into copies, at most.
COPIES = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def copies(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row as often as its column n says, numbered from 0 in `name`; no array is longer than n / COPIES or COPIES."""
    out = df.withColumn("__part", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {COPIES})")))
    return out.withColumn(name, F.explode(F.expr(f"sequence(__part * {COPIES}, least({n}, (__part + 1) * {COPIES}) - 1)"))).drop("__part")
