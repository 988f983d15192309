"""What there is: entities, folders, indexes, attachments, rows rebuilt from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routing, scoring, text
from . import filters
from .aggregates import tree_counts


def located(files: DataFrame, root: str) -> DataFrame:
    """files (path) with the parts that <root>/<source>/<entity_type>/<entity_slug>/<name> names; nulls where it doesn't."""
    part = lambda n: F.nullif(F.regexp_extract("path", rf"(?:^|/){root}/([^/]+)/([^/]+)/([^/]+)/([^/]+)$", n), F.lit(""))
    return files.withColumns({"source": part(1), "entity_type": part(2), "entity_slug": part(3), "name": part(4)})


def entity_files(files: DataFrame, entity: str, root: str) -> DataFrame:
    """All files of one entity 'type/slug', over all sources."""
    kind, _, slug = entity.partition("/")
    return located(files, root).where((F.col("entity_type") == kind) & (F.col("entity_slug") == slug))


def entity_counts(files: DataFrame, root: str) -> DataFrame:
    """(entity_type, entity_slug, source, n)."""
    return located(files, root).where("entity_slug IS NOT NULL").groupBy("entity_type", "entity_slug", "source").agg(F.count("*").alias("n"))


def synthesis_kind(path: Column) -> Column:
    """profile, timeline, moc, digest or index, by a synthesis file's place; null for others."""
    return (
        F.when(path.rlike(r"(?:^|/)index\.md$"), "index")
        .when(path.rlike(r"(?:^|/)digests/[^/]+\.md$"), "digest")
        .when(path.rlike(r"(?:^|/)topics/[^/]+\.md$"), "moc")
        .when(path.rlike(r"/[^/]+/profile\.md$"), "profile")
        .when(path.rlike(r"/[^/]+/timeline\.md$"), "timeline")
    )


def synthesis_path(kind: Column, entity: Column, name: Column) -> Column:
    """Where a synthesis file of a kind belongs."""
    return (
        F.when(kind == "profile", F.concat(entity, F.lit("/profile.md")))
        .when(kind == "timeline", F.concat(entity, F.lit("/timeline.md")))
        .when(kind == "moc", F.concat(F.lit("topics/"), name, F.lit(".md")))
        .when(kind == "digest", F.concat(F.lit("reports/digests/"), name, F.lit(".md")))
        .when(kind == "index", "index.md")
    )


def folder_index_counts(entries: DataFrame, folders: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(folder, indexed, in_range, total) from offsets alone, most in range first. entries: folder, at; folders: folder."""
    from ..functions.dates import in_range

    counts = entries.groupBy("folder").agg(F.count_if(in_range(F.col("at"), since, until)).alias("in_range"), F.count("*").alias("total"))
    out = folders.select("folder").distinct().join(counts, "folder", "left")
    return out.select("folder", F.col("total").isNotNull().alias("indexed"), F.coalesce("in_range", F.lit(0)).cast("long").alias("in_range"), F.coalesce("total", F.lit(0)).cast("long").alias("total")).orderBy(F.desc("in_range"), "folder")


def known_message_ids(files: DataFrame, content: Column) -> DataFrame:
    """Distinct message ids that front matter names."""
    return files.select(F.trim(text.front_matter_field(content, "message-id")).alias("message_id")).where("message_id IS NOT NULL").distinct()


def statted(files: DataFrame, known: DataFrame, extensions: Sequence[str], least: int = 1024) -> DataFrame:
    """files (path, size, mtime) of allowed extensions and size with `state`: unchanged or updated against known rows."""
    some = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions) & (F.col("size") >= least))
    k = known.select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("mtime").alias("__m"))
    same = F.col("size").eqNullSafe(F.col("__s")) & F.col("mtime").eqNullSafe(F.col("__m"))
    return some.join(k, F.col("path") == F.col("__p"), "left").withColumn("state", F.when(same, "unchanged").otherwise("updated")).drop("__p", "__s", "__m")


def classified_directories(files: DataFrame, max_depth: int, documents: Sequence[str], code: Sequence[str], images: Sequence[str], markers: Sequence[str], technical: Sequence[str] = ()) -> DataFrame:
    """(dir, category, confidence, total) down to a depth; nothing below a directory of code, bundles or photos is listed."""
    seen = files.where(~filters.part_matches(F.col("path"), technical)) if technical else files
    counts = tree_counts(seen, documents, code, images)
    parent = F.nullif(F.regexp_replace("path", r"/[^/]*$", ""), F.col("path"))
    marked = files.where(F.substring_index("path", "/", -1).isin(*markers)).select(parent.alias("m")).distinct()
    rows = counts.join(marked, F.col("dir") == F.col("m"), "left")
    kind = routing.classify_directory(F.substring_index("dir", "/", -1), F.col("m").isNotNull(), *(F.col(c) for c in ("documents", "code", "images", "total", "photo_names")))
    rows = rows.select("dir", "total", kind.alias("k")).select("dir", "k.category", "k.confidence", "total")
    last = rows.where(F.col("category").isin("bundle", "code", "photos")).select(F.col("dir").alias("top"))
    parts = F.split("dir", "/")
    above = rows.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("top")).where("top <> dir")
    hidden = above.join(last, "top", "left_semi").select("dir").distinct()
    return rows.join(hidden, "dir", "left_anti").where(F.size(F.split("dir", "/")) <= max_depth)


def promotable(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Attachments of document extensions under mail and notes."""
    return files.where(F.col("path").rlike(r"/(?:Mail|Notes)/.*(?:^|/)Attachments/") & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def obsolete(messages: DataFrame, rules: scoring.Rules, summaries: DataFrame) -> DataFrame:
    """Messages (path, ...) that now score as ignored, with the path of their summary, if any; the last by path counts."""
    scored = scoring.score_messages(messages, rules).where(F.col("score") <= rules.ignore)
    by_source = summaries.groupBy(F.col("source").alias("__s")).agg(F.max("path").alias("summary"))
    return scored.join(by_source, F.col("path") == F.col("__s"), "left").drop("__s")


def reindexed(files: DataFrame, content: Column, file_type: Column, known: DataFrame) -> DataFrame:
    """Rows of the state rebuilt from files (path, size, mtime): fields from front matter, hashes kept while (size, mtime) match.

    A front matter hash is trusted where its size and time match the file's; else the known one, else none.
    """
    field = lambda k: text.front_matter_field(content, k)
    fresh = (field("source_size").cast("long") == F.col("size")) & field("source_mtime").isNotNull() & (field("source_mtime").cast("double") == F.col("mtime").cast("double"))
    rows = files.where(filters.trackable(F.col("path"))).select(
        "path",
        file_type.alias("file_type"),
        field("source").alias("source_path"),
        F.coalesce(field("entity_type"), F.lit(None).cast("string")).alias("entity_type"),
        field("entity_slug").alias("entity_slug"),
        field("created").alias("created"),
        field("modified").alias("modified"),
        F.trim(field("message-id")).alias("message_id"),
        F.when(fresh, text.plain_hash(field("source_hash"))).alias("fm_hash"),
        "size",
        "mtime",
    )
    k = known.select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("mtime").alias("__m"), F.col("hash").alias("__h"))
    out = rows.join(k, F.col("path") == F.col("__p"), "left")
    same = F.col("size").eqNullSafe(F.col("__s")) & F.col("mtime").eqNullSafe(F.col("__m"))
    return out.withColumn("hash", F.coalesce("fm_hash", F.when(same, F.col("__h")))).drop("fm_hash", "__p", "__s", "__m", "__h")


def reindex_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_type, added, removed, changed) between two states."""
    a, b = before.select(F.col("path").alias("p"), F.col("file_type").alias("t"), F.col("hash").alias("h")), after.select("path", "file_type", "hash")
    both = a.join(b, F.col("p") == F.col("path"), "full")
    kind = F.coalesce("file_type", "t").alias("file_type")
    return both.groupBy(kind).agg(F.count_if(F.col("p").isNull()).alias("added"), F.count_if(F.col("path").isNull()).alias("removed"), F.count_if(F.col("p").isNotNull() & F.col("path").isNotNull() & ~F.col("h").eqNullSafe(F.col("hash"))).alias("changed"))


def latest_digests(files: DataFrame) -> DataFrame:
    """Synthesis files by kind; digests newest first, by number."""
    rows = files.withColumn("kind", synthesis_kind(F.col("path"))).where("kind IS NOT NULL")
    order = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "digest", F.col("path")).desc(), "path")
    return rows.withColumn("nth", F.row_number().over(order).cast("long"))


def stored_files(files: DataFrame) -> DataFrame:
    """(path, file_type) of every row."""
    return files.select("path", "file_type")


def newer_notes(notes: DataFrame, mirrors: DataFrame) -> DataFrame:
    """(year, n): notes without a mirror, or newer than it, by times alone; contents are not read. notes, mirrors: path, mtime."""
    m = mirrors.select(F.col("path").alias("__p"), F.col("mtime").alias("__m"))
    todo = notes.join(m, F.col("path") == F.col("__p"), "left").where(F.col("__p").isNull() | (F.col("mtime") > F.col("__m")))
    return todo.groupBy(F.year("mtime").alias("year")).agg(F.count("*").alias("n"))


def messages_of(transcriptions: DataFrame, content: Column, summaries: DataFrame) -> DataFrame:
    """Mail transcriptions (path) as messages for the scorer, with the path of their summary (the last by path), if any."""
    field = lambda k: text.front_matter_field(content, k)
    names = text.attachment_list(content)
    rows = transcriptions.select(
        "path",
        field("from").alias("from_addr"),
        field("to").alias("to"),
        field("cc").alias("cc"),
        field("subject").alias("subject"),
        field("folder").alias("folder"),
        field("message-id").alias("message_id"),
        text.body(content).alias("body"),
        F.lit(False).alias("is_html_only"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.transform(names, lambda n: F.struct(n.alias("filename"), F.lit("").alias("content_type"), F.lit(0).cast("long").alias("size"))).alias("attachments"),
    )
    by_source = summaries.groupBy(F.col("source").alias("__s")).agg(F.max("path").alias("summary"))
    return rows.join(by_source, F.col("path") == F.col("__s"), "left").drop("__s")


def empty_directories(directories: DataFrame, files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(dir, depth): directories (dir) with no file (path) and no kept directory below them, deepest first. What to remove, as a plan's rows."""
    parts = lambda c: F.split(c, "/")
    ups = lambda c, least: F.when(F.size(parts(c)) > least, F.transform(F.sequence(F.lit(1), F.size(parts(c)) - least), lambda i: F.array_join(F.slice(parts(c), F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    full = files.select(F.explode(ups(F.col("path"), 1)).alias("dir"))
    if keep:
        kept = directories.where(F.substring_index("dir", "/", -1).isin(*keep))
        full = full.unionByName(kept.select(F.explode(ups(F.col("dir"), 0)).alias("dir")))
    return directories.select("dir").distinct().join(full.distinct(), "dir", "left_anti").withColumn("depth", F.size(parts(F.col("dir")))).orderBy(F.desc("depth"), "dir")
