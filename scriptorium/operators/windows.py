"""Operators whose natural form is a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise


def numbered(rows: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """rows with `__nth`, their place from 0 in a total order, without one task that sorts all: ranges, counts, offsets."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    out = placed.withColumn("__i", F.row_number().over(inside) - 1).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return out.withColumn("__nth", (F.col("__before") + F.col("__i")).cast("long")).drop("__part", "__p", "__before", "__i")


def even_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows at places floor(i * N / k), i < k, of the order by key; all rows if there are k at most."""
    n = rows.count()
    if n <= k:
        return rows
    placed = numbered(rows, [key])
    first = f"((__nth * {k} + {n - 1}) div {n})"  # the least i whose place is not before this row
    return placed.where(f"{first} < {k} AND ({first} * {n}) div {k} = __nth").drop("__nth")


def recent_per_group(rows: DataFrame, group: str, at: str, key: str, k: int) -> DataFrame:
    """The k latest rows of each group; ties by key."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(at), key)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def collision_suffix(moves: DataFrame, target: str, order: str) -> DataFrame:
    """moves with `final`: the second and later of one target get ' (2)', ' (3)', ..."""
    n = F.row_number().over(Window.partitionBy(target).orderBy(order))
    return moves.withColumn("final", F.when(n == 1, F.col(target)).otherwise(F.concat(F.col(target), F.lit(" ("), n.cast("string"), F.lit(")"))))


def move_or_copy(references: DataFrame) -> DataFrame:
    """references (dir, name, doc, moved) with `action` for those of moved documents: copy while another document still refers, else move."""
    held = references.where("NOT moved").select(F.col("dir").alias("__d"), F.col("name").alias("__n")).distinct()
    out = references.where("moved").join(held, F.col("dir").eqNullSafe(F.col("__d")) & F.col("name").eqNullSafe(F.col("__n")), "left")
    return out.withColumn("action", F.when(F.col("__n").isNotNull() | F.col("__d").isNotNull(), "copy").otherwise("move")).drop("__d", "__n")


def keepers(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, keep, n): the least key of each group, by partial aggregates."""
    return rows.groupBy(group).agg(F.min(key).alias("keep"), F.count("*").alias("n"))


def islands(lines: DataFrame, group: str, nth: str, flag: str) -> DataFrame:
    """(group, start, stop): runs of consecutive lines for which the flag holds."""
    on = lines.where(F.col(flag)).withColumn("__g", F.col(nth) - F.row_number().over(Window.partitionBy(group).orderBy(nth)))
    return on.groupBy(group, "__g").agg(F.min(nth).alias("start"), F.max(nth).alias("stop")).drop("__g")


def requests_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Requests of one source type next to each other, so that equal prompts share a cache."""
    spread = rows.repartitionByRange(parts, "source_type", "custom_id") if parts else rows.repartitionByRange("source_type", "custom_id")
    return spread.sortWithinPartitions("source_type", "custom_id")
