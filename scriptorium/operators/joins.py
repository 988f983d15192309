"""Missing, stale, orphaned and resolved: anti-joins, staleness joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(items: DataFrame, done: DataFrame, key: str, done_key: str, where: Column | None = None) -> DataFrame:
    """items that nothing in `done` points to."""
    items = items if where is None else items.where(where)
    return items.join(done.select(F.col(done_key).alias("__done")).where("__done IS NOT NULL").distinct(), F.col(key) == F.col("__done"), "left_anti")


def missing_summaries(files: DataFrame, source_type: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Transcriptions of `files` without a summary, newest first."""
    t = files.where("file_type = 'transcription'")
    if source_type:
        t = t.where(F.col("source_type") == source_type)
    if since:
        t = t.where(F.col("created") >= since)
    if until:
        t = t.where(F.col("created") < until)
    return missing(t, files.where("file_type = 'summary'"), "path", "source_path").orderBy(F.desc_nulls_last("created"), "path")


def unorganized(summaries: DataFrame) -> DataFrame:
    """Summaries (path, entity_type, created) that are filed under no entity, newest first, undated ones last."""
    return summaries.where("entity_type IS NULL").orderBy(F.desc_nulls_last("created"), "path")


def stale_groups(parts: DataFrame, wholes: DataFrame, key: str, at: str = "at", whole_at: str = "whole_at") -> DataFrame:
    """(key, at, whole_at): groups without a whole, or whose newest part is newer than it.

    With a dated whole and no dated part a group is not stale.
    """
    newest = parts.groupBy(key).agg(F.max(at).alias("at"))
    whole = wholes.groupBy(F.col(key).alias("__k")).agg(F.max(whole_at).alias("whole_at"))
    return newest.join(whole, F.col(key) == F.col("__k"), "left").where("whole_at IS NULL OR whole_at < at").drop("__k")


def stale_pairs(sources: DataFrame, derived: DataFrame, key: str, source_at: str, derived_at: str) -> DataFrame:
    """Equi-join with a residual: derived rows older than their source. Both columns must be set."""
    return sources.join(derived, key).where(F.col(source_at) > F.col(derived_at))


def orphans(files: DataFrame, references: DataFrame) -> DataFrame:
    """files (dir, name) that no reference of the same directory names."""
    return files.join(references.select("dir", "name").distinct(), ["dir", "name"], "left_anti")


def broken_links(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return references.join(targets.select(key).distinct(), key, "left_anti")


def resolve_aliases(rows: DataFrame, aliases: DataFrame, identifier: str) -> DataFrame:
    """rows with `entity`: by exact alias (any case) or a wildcard *@domain; of several, the least rank, then slug, wins.

    aliases: alias, entity_type, slug, rank (type order, then position in its list). Two equi-joins, no theta join.
    """
    plain = aliases.select(F.lower(F.trim("alias")).alias("__alias"), F.concat_ws("/", "entity_type", "slug").alias("entity"), "rank", "slug")
    best = Window.partitionBy("__alias").orderBy("rank", "slug")
    plain = plain.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    wild = plain.where("__alias LIKE '*@%'").select(F.expr("substring(__alias, 3)").alias("__domain"), F.col("entity").alias("wild_entity"), F.col("rank").alias("wild_rank"), F.col("slug").alias("wild_slug"))
    exact = plain.where("NOT __alias LIKE '*@%'").withColumnRenamed("entity", "exact_entity").withColumnRenamed("rank", "exact_rank").withColumnRenamed("slug", "exact_slug")
    who = F.lower(F.trim(identifier))
    out = rows.withColumn("__who", who).withColumn("__at", F.when(who.contains("@"), F.substring_index(who, "@", -1)))
    out = out.join(exact, F.col("__who") == F.col("__alias"), "left").join(wild, F.col("__at") == F.col("__domain"), "left")
    wild_first = F.col("exact_entity").isNull() | (F.struct("wild_rank", "wild_slug") < F.struct("exact_rank", "exact_slug"))
    entity = F.when(F.col("wild_entity").isNotNull() & wild_first, F.col("wild_entity")).otherwise(F.col("exact_entity"))
    return out.withColumn("entity", entity).drop("__who", "__at", "__alias", "__domain", "exact_entity", "exact_rank", "exact_slug", "wild_entity", "wild_rank", "wild_slug")


def source_candidates(mirrors: DataFrame, files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """mirrors (path) with `source`: the file of the same directory and stem whose extension stands first in the list."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    found = files.select(F.col("path").alias("source"), stem(F.col("path")).alias("__stem"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("__ext")).where(F.col("__ext").isin(*extensions))
    order = F.struct(F.array_position(F.array(*map(F.lit, extensions)), F.col("__ext")), "source")
    first = found.groupBy("__stem").agg(F.min_by("source", order).alias("source"))
    return mirrors.withColumn("__m", stem(F.col("path"))).join(first, F.col("__m") == F.col("__stem"), "left").drop("__m", "__stem")


def find_attachment(references: DataFrame, files: DataFrame, central: str) -> DataFrame:
    """references (name) with `path`: of the files of that name, one in the central folder if there is any, else the least path."""
    order = F.struct(F.when(F.col("path").startswith(central + "/"), 0).otherwise(1), "path")
    named = files.select(F.substring_index("path", "/", -1).alias("name"), "path").groupBy("name").agg(F.min_by("path", order).alias("path"))
    return references.join(named, "name", "left")


def document_scan(sources: DataFrame, mirrors: DataFrame, hashes: DataFrame) -> DataFrame:
    """sources with `outcome`: emit, emit_changed, emit_hashed, existing or known_hash.

    sources: path, size, mtime, hash (may be computed only where asked for); mirrors: path, size, mtime, hash (as stored);
    hashes: path, size, hash of every tracked file. Unchanged (size, mtime) means existing; else the hash decides; new
    files are compared by hash only with files of their size.
    """
    m = mirrors.select(F.col("path").alias("__p"), F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"), F.col("hash").alias("m_hash"))
    same_size = hashes.groupBy(F.col("size").alias("__s")).agg(F.count("*").alias("peers"))
    same_hash = hashes.groupBy(F.col("size").alias("__s2"), F.col("hash").alias("__h")).agg(F.min("path").alias("twin"), F.max("path").alias("last_twin"))
    out = sources.join(m, F.col("path") == F.col("__p"), "left").join(same_size, F.col("size") == F.col("__s"), "left").join(same_hash, (F.col("size") == F.col("__s2")) & (F.col("hash") == F.col("__h")), "left")
    known = (F.col("twin") != F.col("path")) | (F.col("last_twin") != F.col("path"))
    outcome = (
        F.when(F.col("__p").isNotNull() & (F.col("size") == F.col("m_size")) & (F.col("mtime") == F.col("m_mtime")), "existing")
        .when(F.col("__p").isNotNull() & (F.col("m_hash").isNull() | (F.col("hash") == F.col("m_hash"))), "existing")
        .when(F.col("__p").isNotNull(), "emit_changed")
        .when(F.col("peers").isNull(), "emit")
        .when(known, "known_hash")
        .otherwise("emit_hashed")
    )
    return out.withColumn("outcome", outcome).select(*sources.columns, "outcome")


def note_scan(notes: DataFrame, mirrors: DataFrame) -> DataFrame:
    """notes (path, mtime) that are new or newer than their mirror, with `reason`."""
    m = mirrors.select(F.col("path").alias("__p"), F.col("mtime").alias("m_mtime"))
    out = notes.join(m, F.col("path") == F.col("__p"), "left").withColumn("reason", F.when(F.col("__p").isNull(), "new").when(F.col("mtime") > F.col("m_mtime"), "newer"))
    return out.where("reason IS NOT NULL").drop("__p", "m_mtime")


def triplets(summaries: DataFrame, transcriptions: DataFrame, originals: DataFrame) -> DataFrame:
    """(path, issue): summaries without their transcription, transcriptions without their original."""
    a = missing(summaries, transcriptions, "source_path", "path").select("path", F.lit("no_transcription").alias("issue"))
    b = missing(transcriptions.where("source_path IS NOT NULL"), originals, "source_path", "path").select("path", F.lit("no_original").alias("issue"))
    return a.unionByName(b)


def referencing(documents: DataFrame, names: DataFrame, content: str = "text") -> DataFrame:
    """(path, name): documents whose text holds a file name as a whole word of a path or link; an equi-join on the words that could be names.

    A name with blanks is looked for by its last word first, and then as a whole.
    """
    last = F.substring_index(F.substring_index("name", "/", -1), " ", -1)
    wanted = names.select("name", last.alias("__w")).distinct()
    words = documents.select("path", content, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r"""([^\s/()\[\]"'<>]+)"""), 1))).alias("__word"))
    return words.join(wanted, F.col("__word") == F.col("__w")).where(F.col(content).contains(F.col("name"))).select("path", "name").distinct()
