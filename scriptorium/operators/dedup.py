"""Duplicates by content, with a size prefilter before hashing; multiset differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_twins(files: DataFrame) -> DataFrame:
    """(path, size): files that share their size with another; others need no hash."""
    crowded = files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return files.join(crowded, "size", "left_semi")


def duplicates(files: DataFrame, digest: Column) -> DataFrame:
    """(path, size, hash, keep, group_size): files whose content another file has; keep is the least path.

    Only files that share a size are hashed: the semi-join stands before the projection.
    """
    hashed = size_twins(files).select("path", "size", digest.alias("hash"))
    groups = hashed.groupBy(F.col("size").alias("s"), F.col("hash").alias("h")).agg(F.min("path").alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    return hashed.join(groups, (F.col("size") == F.col("s")) & (F.col("hash") == F.col("h"))).drop("s", "h")


def multiset_diff(before: DataFrame, after: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, missing, added): how often an item is short or extra after a change. One aggregate over both, no join."""
    both = before.select(key, item, F.lit(1).alias("w")).unionByName(after.select(key, item, F.lit(-1).alias("w")))
    out = both.groupBy(key, item).agg(F.sum("w").alias("d")).where("d <> 0")
    return out.select(key, item, F.greatest("d", F.lit(0)).cast("long").alias("missing"), F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("added"))


def preserved(diff: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, ok): whether a change kept every token."""
    bad = diff.select(F.col(key).alias("__k")).distinct()
    return items.select(key).distinct().join(bad, F.col(key) == F.col("__k"), "left").select(key, F.col("__k").isNull().alias("ok"))
