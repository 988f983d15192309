"""State as snapshots: every change is a DataFrame from old state to new; swap() replaces a stored one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, always: Sequence[str] = ()) -> DataFrame:
    """Rows by key: new values that aren't null win, the rest stays; columns in `always` are overwritten even by null.

    Columns that only one side has stay null for the other's rows.
    """
    columns = [key, *dict.fromkeys(c for c in (*old.columns, *new.columns) if c != key)]
    a = old.select(*(F.col(c).alias(f"a_{c}") for c in old.columns))
    b = new.select(*(F.col(c).alias(f"b_{c}") for c in new.columns))
    joined = a.join(b, F.col(f"a_{key}") == F.col(f"b_{key}"), "full")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"a_{c}")
        if c not in old.columns:
            return F.col(f"b_{c}")
        if c in always:
            return F.when(F.col(f"b_{key}").isNotNull(), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
        return F.coalesce(f"b_{c}", f"a_{c}")

    return joined.select(*(value(c).alias(c) for c in columns))


def move(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files under their new paths; moves: old, new, entity_type, entity_slug."""
    m = moves.select(F.col("old").alias("__old"), F.col("new").alias("__new"), F.col("entity_type").alias("__t"), F.col("entity_slug").alias("__s"))
    out = files.join(m, F.col("path") == F.col("__old"), "left")
    put = {"path": F.coalesce("__new", "path"), "entity_type": F.coalesce("__t", "entity_type"), "entity_slug": F.coalesce("__s", "entity_slug")}
    return out.select(*(put.get(c, F.col(c)).alias(c) for c in files.columns))


def refresh_stats(files: DataFrame, stats: DataFrame) -> DataFrame:
    """files with size and mtime as seen now; the hash goes where either changed. stats: path, size, mtime."""
    s = stats.select(F.col("path").alias("__p"), F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    out = files.join(s, F.col("path") == F.col("__p"), "full")
    same = F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime"))
    put = {
        "path": F.coalesce("path", "__p"),
        "size": F.coalesce("__size", "size"),
        "mtime": F.coalesce("__mtime", "mtime"),
        "hash": F.when(F.col("__p").isNull() | same, F.col("hash")),
    }
    return out.select(*(put.get(c, F.col(c)).alias(c) for c in files.columns))


def cached_hash(files: DataFrame, known: DataFrame, compute: Column) -> DataFrame:
    """files (path, size, mtime) with `hash`: the known one where (size, mtime) match, computed elsewhere."""
    k = known.select(F.col("path").alias("__p"), F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("hash").alias("__hash"))
    out = files.join(k, F.col("path") == F.col("__p"), "left")
    fresh = (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime")) & F.col("__hash").isNotNull()
    return out.withColumn("hash", F.when(fresh, F.col("__hash")).otherwise(compute)).drop("__p", "__size", "__mtime", "__hash")


def prune(files: DataFrame, present: DataFrame) -> DataFrame:
    """files that still exist."""
    return files.join(present.select("path").distinct(), "path", "left_semi")


def pruned_counts(files: DataFrame, present: DataFrame) -> DataFrame:
    """(file_type, n): how many rows prune() drops."""
    return files.join(present.select("path").distinct(), "path", "left_anti").groupBy("file_type").agg(F.count("*").alias("n"))


def delete(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path").distinct(), "path", "left_anti")


def without_type(files: DataFrame, file_type: str) -> DataFrame:
    return files.where(~F.col("file_type").eqNullSafe(file_type))


def journal_row(spark: SparkSession, ts: str, component: str, operation: str, status: str = "success", source_type: str | None = None, source_path: str | None = None, dest_path: str | None = None, details: str | None = None) -> DataFrame:
    schema = "ts string, component string, operation string, source_type string, source_path string, dest_path string, status string, details string"
    return spark.createDataFrame([(ts, component, operation, source_type, source_path, dest_path, status, details)], schema)


def latest(journal: DataFrame, operation: str | None = None, source_type: str | None = None, k: int = 100) -> DataFrame:
    """The k newest journal rows; ties by their paths."""
    out = journal
    if operation:
        out = out.where(F.col("operation") == operation)
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    return out.orderBy(F.desc("ts"), *(c for c in ("source_path", "dest_path") if c in out.columns)).limit(k)


def at_path(files: DataFrame, path: str) -> DataFrame:
    """The row of one path: none or one."""
    return files.where(F.col("path") == path).limit(1)


def registered_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files after hashes (path, hash, size, mtime) were registered: new paths become rows of type source, known ones keep their type."""
    new = hashes.select("path", "hash", "size", "mtime", F.lit("source").alias("file_type"))
    out = upsert(files.withColumn("__had", F.col("file_type")), new, "path")
    return out.withColumn("file_type", F.coalesce("__had", "file_type")).drop("__had")


def register_documents(done: DataFrame, files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, problems) after transcriptions were registered. done: source_path, path, hash, size, mtime, birth.

    A transcription outside the root is a problem, not a row. Dates come from the source's times, else its name.
    """
    from ..functions import dates

    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").contains("/../")
    when = dates.source_dates(F.col("birth"), F.col("mtime"), F.col("source_path"))
    rows = done.where(inside).withColumn("__d", when).select("path", F.lit("transcription").alias("file_type"), F.lit("document").alias("source_type"), "source_path", "hash", "size", "mtime", F.col("__d.created").alias("created"), F.col("__d.modified").alias("modified"))
    return upsert(files, rows, "path"), done.where(~F.coalesce(inside, F.lit(False))).select("path", F.lit("outside_root").alias("reason"))


def recovered(transcriptions: DataFrame, sources: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """(path, source_path): what to register for transcriptions that are there already; without an original, themselves."""
    from . import filters, joins

    some = transcriptions.where(filters.trackable(F.col("path")))
    found = joins.source_candidates(some, sources, extensions)
    return found.select("path", F.coalesce("source", "path").alias("source_path"))


def usage_rows(usage: DataFrame, cost: Column) -> DataFrame:
    """Usage to append, with its cost; empty usage (no tokens of any kind) leaves no row."""
    kinds = ("input_tokens", "output_tokens", "cache_write", "cache_read")
    some = sum((F.coalesce(F.col(k), F.lit(0)) for k in kinds), F.lit(0)) > 0
    return usage.where(some).withColumn("cost", cost)


def swap(new: DataFrame, path: str) -> None:
    """Store a new state as the next numbered snapshot under path; the one being read stays, and one that breaks off never counts."""
    n = current(new.sparkSession, path)
    new.write.mode("overwrite").parquet(f"{path}/snapshot={0 if n is None else n + 1:08d}")


def current(spark: SparkSession, path: str) -> int | None:
    """The number of the newest complete snapshot."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if s.getPath().getName().startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    n = current(spark, path)
    return None if n is None else spark.read.parquet(f"{path}/snapshot={n:08d}")
