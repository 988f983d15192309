"""Markdown artefacts: one row for each file; tables found in them; what looks broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import routing, text


def read(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, fm (map of the front matter), body, mtime, size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows.select("path", text.front_matter(F.coalesce(text.front_matter_block(F.col("text")), F.lit(""))).alias("fm"), text.body(F.col("text")).alias("body"), "mtime", "size")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def table_blocks(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, start, end, in_table, columns, rows, empty): runs of pipe lines (numbered from 0) and the tables in them.

    A line whose next is a divider of pipes, blanks, colons and three dashes in a row heads a table, unless an earlier table of
    its run took it in: a table lasts to the end of its run of pipe lines. So of each run, what stands before its first
    heading is loose. columns: cells of the heading; rows: its data rows; empty: those more than half empty.
    Lines are exploded and runs found by their numbers: a text of any length is sorted, not held.
    """
    pipe = F.trim(F.col("line")).startswith("|")
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.regexp_replace(F.rtrim(c), r"^\|+|\|+$", ""), r"[ \t]+", " "), r"\|"), lambda x: F.trim(x))
    lines = rows.select(F.col(key).alias("k"), content.alias("t")).where(F.col("t").contains("|")).select("k", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    order = Window.partitionBy("k").orderBy("n")
    divider = F.coalesce(F.lead("line").over(order).rlike(r"^\s*\|[\s\-:|]+\|\s*$") & F.lead("line").over(order).contains("---"), F.lit(False))
    lines = lines.withColumn("heads", F.col("line").startswith("|") & divider).where(pipe | F.col("heads"))
    lines = lines.withColumn("run", F.col("n") - F.row_number().over(order))
    lines = lines.withColumn("head", F.min(F.when(F.col("heads"), F.col("n"))).over(Window.partitionBy("k", "run")))
    held = cells(F.col("line"))
    data = F.col("n") >= F.col("head") + 2
    bare = data & (F.size(F.filter(held, lambda c: c == "")) > 0.5 * F.size(held))
    inside = F.coalesce(F.col("n") >= F.col("head"), F.lit(False))
    out = lines.withColumn("in_table", inside).groupBy("k", "run", "in_table").agg(F.min("n").alias("start"), F.max("n").alias("end"), F.max(F.when(F.col("n") == F.col("head"), F.size(held))).alias("columns"), F.count_if(data).alias("rows"), F.count_if(bare).alias("empty"))
    return out.select(F.col("k").alias(key), "start", "end", "in_table", "columns", "rows", "empty")


def suspicious(rows: DataFrame, key: str, content: Column, least: int = 2) -> DataFrame:
    """(key, score, tables, loose): texts whose tables look broken.

    The score is 2 for each loose block; of tables with some filled row, their mostly empty rows if there are two and 40 % at
    least, and 1 if they have 7 columns and 3 rows at least.
    """
    blocks = table_blocks(rows, key, content)
    hollow = F.when((F.col("empty") >= 2) & (F.col("empty") >= 0.4 * F.col("rows")), F.col("empty")).otherwise(0)
    wide = ((F.col("columns") >= 7) & (F.col("rows") >= 3)).cast("int")
    points = F.when(~F.col("in_table"), 2).when(F.col("empty") == F.col("rows"), 0).otherwise(hollow + wide)
    out = blocks.groupBy(key).agg(F.sum(points).cast("long").alias("score"), F.count_if("in_table").alias("tables"), F.count_if(~F.col("in_table")).alias("loose"))
    return out.where(F.col("score") >= least)


def actions(rows: DataFrame, entity: str, content: Column, touched: Column, as_of: str, status: str = "all", of: str | None = None) -> DataFrame:
    """(entity, nth, action, due, status, reason): open boxes of timelines, of one status or entity if asked; sorted: expired
    ones first, then by due date, undated ones last."""
    if status not in ("all", "open", "expired"):
        raise ValueError(f"no such status: {status}")
    some = rows if of is None else rows.where(F.col(entity) == of)
    found = open_actions(some.withColumn("__touched", touched), entity, content, "__touched")
    state = routing.action_status(F.col("due"), F.col("__touched"), as_of)
    found = found.withColumn("status", state).withColumn("reason", F.when((F.col("status") == "expired") & F.col("due").isNotNull(), "overdue").when(F.col("status") == "expired", "idle")).drop("__touched")
    found = found if status == "all" else found.where(F.col("status") == status)
    return found.orderBy(F.when(F.col("status") == "expired", 0).otherwise(1), F.col("due").asc_nulls_last(), entity, "nth")


def open_actions(rows: DataFrame, key: str, content: Column, *others: str) -> DataFrame:
    """(key, others, nth, action, due): unchecked boxes with their due date, if any."""
    lines = rows.select(key, *others, F.posexplode(F.regexp_extract_all(content, F.lit(r"(?m)^\s*[-*] \[ \] (.+?)\s*$"), 1)).alias("nth", "line"))
    due = F.try_to_date(F.nullif(F.regexp_extract("line", r"[—-]\s*(?:(?:due|échéance)\s*:?\s*)?(\d{4}-\d{2}-\d{2})$", 1), F.lit("")), "yyyy-MM-dd")
    return lines.select(key, *others, "nth", F.regexp_replace("line", r"\s*[—-]\s*(?:(?:due|échéance)\s*:?\s*)?\d{4}-\d{2}-\d{2}$", "").alias("action"), due.alias("due"))


def message_markdown(row: dict[str, Column]) -> Column:
    """A message as Markdown with front matter; row: columns by field name."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    fields = F.array_join(F.array(*(F.concat(F.lit(f"{k}: "), quoted(row[k])) for k in row if k != "body")), "\n")
    return F.concat(F.lit("---\ntype: mail\n"), fields, F.lit("\n---\n\n"), text.compress(text.cut_replies(F.coalesce(row["body"], F.lit("")))), F.lit("\n"))


def merged_front_matter(old: Column, new: Column) -> Column:
    """Two maps: values of the new one that aren't null win, other fields stay."""
    fresh = F.map_filter(new, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)


def transcribed_at(old_hash: Column, new_hash: Column, old_at: Column, now: Column) -> Column:
    """Stays while the source's hash does."""
    return F.when(old_hash.eqNullSafe(new_hash) & old_at.isNotNull(), old_at).otherwise(now)
