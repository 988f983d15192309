"""The corpus pipeline: quality, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as a table and hands
them to the next. All stages but the last return the columns of documents, and extra columns that docs may have.
Null texts count as empty ones in every stage; null ids and sources are values like others; texts may be of any length
and are always read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, exact_dedup, mixing, quality, simhash
from scriptorium.llm.common import documents
from scriptorium.tables import materialise


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay whose text scores at least the classifier's threshold. It is trained on the labelled rows of its own input.

    Each row is judged by its text alone: rows that repeat share a fate, and an empty or null text has the empty text's score.
    Without labels of both classes all rows have one score, and stay if that is at least the threshold.
    """
    return quality.accept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts that of the largest doc_id stays (null is less than any), and one only where it repeats.

    Null and empty texts are equal. Rows that share a doc_id but not their text are judged each.
    """
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with linked fingerprints that of the smallest doc_id stays (null after all others); of its texts, that of least hash.

    Texts without a word are linked to each other. Rows that share a doc_id but not their text are judged each.
    """
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the Pfair schedule of their sources, whose targets are sizes to the power 0.7.

    Null sources are a source. Rows equal in doc_id, source and text stand together.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, position: a training row for each row of docs; its order is that of position, the place in mix_sources' schedule.

    Empty and null texts have no ids. Rows equal in doc_id, source and text share a position. Extra columns go.
    """
    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"))
    rows = bpe.encoded(mixing.with_places(rows, docs, "text_key"))  # placed before they are encoded: ids take more room than texts
    return rows.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "position")


STAGES = [
    ("quality_filter", quality_filter),
    ("drop_exact_copies", drop_exact_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Compression, fingerprints of shingles and BPE can't be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
