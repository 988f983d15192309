"""Plans: DataFrames of (action, src, dst, reason), and content where something is written. Nothing here touches files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import filters, joins, windows
from ..operators.inventory import synthesis_path
from ..sources import markdown


def extract(messages: DataFrame, rules: scoring.Rules, known: DataFrame, existing: DataFrame, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Mail to Markdown: (action, src, dst, reason, content). Known ids, rejected messages and existing targets are skipped, in this order.

    messages: the mail source's columns; known: message_id; existing: path.
    """
    rows = scoring.score_messages(messages, rules)
    reason = filters.mail_reason(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.col("score"), F.col("reasons"), rules, since, until)
    name = F.concat(text.file_name(F.date_format("date", "yyyy-MM-dd"), F.col("subject")), F.lit(" "), F.col("msg_hash"), F.lit(".md"))
    rows = rows.withColumn("dst", F.concat_ws("/", F.lit(root), "folder", name))
    seen = known.select(F.trim("message_id").alias("__k")).where("__k <> ''").distinct()
    there = existing.select(F.col("path").alias("__p")).distinct()
    rows = rows.join(seen, F.trim("message_id") == F.col("__k"), "left").join(there, F.col("dst") == F.col("__p"), "left")
    ignored = F.lower("folder").isin(*[f.lower() for f in rules.ignored_folders])
    why = F.when(ignored, "ignored_folder").when(F.col("__k").isNotNull(), "known_id").when(reason.isNotNull(), reason).when(F.col("__p").isNotNull(), "target_exists")
    fields = {"created": F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), "from": F.col("from_addr"), "to": F.col("to"), "subject": F.col("subject"), "message-id": F.coalesce("message_id", F.lit("")), "folder": F.col("folder"), "body": F.col("body")}
    content = markdown.message_markdown(fields)
    return rows.select(F.when(why.isNull(), "write").otherwise("skip").alias("action"), F.col("message_id").alias("src"), "dst", why.alias("reason"), F.when(why.isNull(), content).alias("content"))


def counts(plan: DataFrame) -> DataFrame:
    """(action, reason, n); reasons by what stands before a colon or score."""
    return plan.groupBy("action", F.regexp_extract(F.coalesce("reason", F.lit("")), r"^([a-z_]*)", 1).alias("reason")).agg(F.count("*").alias("n"))


def attachment_name(payload: Column, filename: Column) -> Column:
    """A name that only depends on the content."""
    return F.concat(F.substring(F.sha2(payload, 256), 1, 32), F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1)))


def copy_notes(notes: DataFrame, mirrors: DataFrame, source_root: str, mirror_root: str) -> DataFrame:
    """Notes that are new or newer than their mirror; notes and mirrors: path relative to their root, mtime."""
    found = joins.note_scan(notes, mirrors)
    return found.select(F.when(F.col("reason") == "new", "copy").otherwise("replace").alias("action"), F.concat(F.lit(source_root + "/"), "path").alias("src"), F.concat(F.lit(mirror_root + "/"), "path").alias("dst"), "reason")


def promote(attachments: DataFrame, tracked: DataFrame, target: str) -> DataFrame:
    """Attachments (path, hash) to copy to a folder: one of each content, none that another tracked file has; names that collide are numbered."""
    one = attachments.groupBy("hash").agg(F.min("path").alias("path"))
    own = attachments.select(F.col("path").alias("__a")).distinct()
    others = tracked.join(own, F.col("path") == F.col("__a"), "left_anti").select(F.col("hash").alias("__h")).distinct()
    rows = one.join(others, F.col("hash") == F.col("__h"), "left")
    new = windows.collision_suffix(rows.where("__h IS NULL").withColumn("name", F.substring_index("path", "/", -1)), "name", "path")
    copies = new.select(F.lit("copy").alias("action"), F.col("path").alias("src"), F.concat(F.lit(target + "/"), "final").alias("dst"), F.lit(None).cast("string").alias("reason"))
    return copies.unionByName(rows.where("__h IS NOT NULL").select(F.lit("skip").alias("action"), F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("known_hash").alias("reason")))


def deduplicate(duplicates: DataFrame) -> DataFrame:
    """duplicates (path, keep, size): all but the keeper go; `freed` is what that saves."""
    return duplicates.where("path <> keep").select(F.lit("delete").alias("action"), F.col("path").alias("src"), F.col("keep").alias("dst"), F.lit("duplicate").alias("reason"), F.col("size").alias("freed"))


def relinked(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, old, new): references of documents (path, name) to names that a plan replaces: an equi-join on the name, no substring search."""
    gone = plan.where("action = 'delete' AND dst IS NOT NULL").select(F.substring_index("src", "/", -1).alias("name"), F.substring_index("dst", "/", -1).alias("new"))
    return documents.join(gone.distinct(), "name").select("path", F.col("name").alias("old"), "new").distinct()


def clean_orphans(files: DataFrame, references: DataFrame) -> DataFrame:
    """Attachments (dir, name, size) that no document of the directory refers to."""
    lone = joins.orphans(files, references)
    return lone.select(F.lit("delete").alias("action"), F.concat_ws("/", "dir", "name").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("orphan").alias("reason"), F.col("size").alias("freed"))


def freed(plan: DataFrame) -> DataFrame:
    """(n, bytes) of what a plan deletes."""
    return plan.where("action = 'delete'").agg(F.count("*").alias("n"), F.coalesce(F.sum("freed"), F.lit(0)).alias("bytes"))


def repair(references: DataFrame, files: DataFrame, central: str) -> DataFrame:
    """References (dir, name) without a file, copied from the central folder, else from any folder that has one of that name."""
    present = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.substring_index("path", "/", -1).alias("name"))
    broken = references.select("dir", "name").distinct().join(present.distinct(), ["dir", "name"], "left_anti")
    found = joins.find_attachment(broken, files, central)
    return found.select(F.when(F.col("path").isNull(), "skip").otherwise("copy").alias("action"), F.col("path").alias("src"), F.concat_ws("/", "dir", "name").alias("dst"), F.when(F.col("path").isNull(), "not_found").alias("reason"))


def archive(rows: DataFrame, root: str, day: str) -> DataFrame:
    """rows (path, category) to a dated archive; equal targets are numbered."""
    target = F.concat_ws("/", F.lit(root), F.lit(day), "category", F.substring_index("path", "/", -1))
    moved = windows.collision_suffix(rows.withColumn("target", target), "target", "path")
    return moved.select(F.lit("move").alias("action"), F.col("path").alias("src"), F.col("final").alias("dst"), F.lit("archived").alias("reason"))


def collect_moves(excluded: DataFrame, report: DataFrame, included: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """excluded (path) with their category in a scan report (path, category), without included ones, known categories only."""
    rows = excluded.where(~filters.starts_with_any(F.col("path"), included)).join(report.select("path", "category"), "path", "left")
    return rows.where(F.col("category").isin(*categories))


def register(results: DataFrame, root: str) -> DataFrame:
    """Synthesis results (kind, entity, name, content) to write; both parts of an entity's answer become files of their own."""
    parts = text.split_parts(F.col("content"))
    both = results.where("kind = 'entity'").withColumn("parts", parts)
    error = both.where("parts IS NULL").select(F.lit("skip").alias("action"), F.lit(None).cast("string").alias("dst"), F.lit("missing_marker").alias("reason"), F.lit(None).cast("string").alias("content"))
    split = both.where("parts IS NOT NULL").select("entity", "name", F.explode(F.array(F.struct(F.lit("profile").alias("kind"), F.col("parts.first").alias("content")), F.struct(F.lit("timeline").alias("kind"), F.col("parts.second").alias("content")))).alias("x")).select("x.kind", "entity", "name", "x.content")
    every = results.where("kind <> 'entity'").select("kind", "entity", "name", text.unfenced(F.col("content")).alias("content")).unionByName(split)
    target = synthesis_path(F.col("kind"), F.col("entity"), F.col("name"))
    reason = F.when(target.isNull(), "unknown_kind")
    plan = every.select(F.when(reason.isNull(), "write").otherwise("skip").alias("action"), F.concat(F.lit(root + "/"), target).alias("dst"), reason.alias("reason"), "content")
    return plan.unionByName(error).withColumn("src", F.lit(None).cast("string")).select("action", "src", "dst", "reason", "content")


def summaries(ingested: DataFrame, transcriptions: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """Summaries to write beside nothing else: (action, src, dst, reason, content). Dates come from the transcription.

    ingested: what operators.requests.ingest() gives; transcriptions: path, created, modified.
    """
    t = transcriptions.select(F.col("path").alias("__p"), "created", "modified")
    rows = ingested.join(t, F.col("source") == F.col("__p"), "left")
    reason = F.coalesce(F.col("error"), F.when(~F.col("source").startswith(source_root + "/"), "outside_root"), F.when(F.col("__p").isNull(), "no_transcription"))
    head = F.concat(F.lit("---\nsource: "), F.col("source"), F.lit("\ncreated: "), F.coalesce("created", F.lit("")), F.lit("\nmodified: "), F.coalesce("modified", F.lit("")), F.lit("\n"))
    rest = F.regexp_replace(F.coalesce(text.front_matter_block(F.col("markdown")), F.lit("")), r"(?m)^(?:source|created|modified):.*\n?", "")
    content = F.concat(head, F.regexp_replace(rest, r"\n*\z", ""), F.when(rest == "", "").otherwise("\n"), F.lit("---\n\n"), text.body(F.col("markdown")))
    return rows.select(F.when(reason.isNull(), "write").otherwise("skip").alias("action"), F.col("source").alias("src"), text.mirror_path(F.col("source"), source_root, target_root).alias("dst"), reason.alias("reason"), F.when(reason.isNull(), content).alias("content"))


def optimise(promotions: DataFrame, duplicates: DataFrame, orphans: DataFrame) -> DataFrame:
    """One plan of the three, with a step."""
    out = None
    for step, plan in (("promote", promotions), ("dedup", duplicates), ("orphans", orphans)):
        rows = plan.select(F.lit(step).alias("step"), "action", "src", "dst", "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def scope_lists(config: Mapping[str, Sequence[str]], include: str | None = None, exclude: str | None = None, moved: Sequence[str] = ()) -> dict[str, list[str]]:
    """Folder lists after adding to one, each folder once, and without the folders that moved away. Spelling variants of a letter are equal."""
    import unicodedata

    same = lambda x: unicodedata.normalize("NFC", x)
    out = {k: list(config.get(k, ())) for k in ("included", "excluded")}
    for k, folder in (("included", include), ("excluded", exclude)):
        if folder is not None and same(folder) not in map(same, out[k]):
            out[k].append(folder)
    gone = set(map(same, moved))
    return {k: [x for x in v if same(x) not in gone] for k, v in out.items()}


def save_attachments(attachments: DataFrame, folder: str) -> DataFrame:
    """(action, src, dst, reason, payload): payloads under names of their own content, equal ones once. attachments: msg_hash, filename, payload."""
    named = attachments.withColumn("dst", F.concat(F.lit(folder + "/"), attachment_name(F.col("payload"), F.col("filename"))))
    first = named.groupBy("dst").agg(F.min(F.struct("msg_hash", "filename")).alias("f"), F.first("payload").alias("payload"))
    return first.select(F.lit("write").alias("action"), F.concat_ws("/", "f.msg_hash", "f.filename").alias("src"), "dst", F.lit(None).cast("string").alias("reason"), "payload")


def archive_manifest(plan: DataFrame, day: str, config_hash: str) -> DataFrame:
    """(day, config, from, to): what an archive's manifest says, a row for each moved file; written as JSON lines beside it."""
    return plan.where("action = 'move'").select(F.lit(day).alias("day"), F.lit(config_hash).alias("config"), F.col("src").alias("from"), F.col("dst").alias("to"))


def obsolete_report(scored: DataFrame) -> DataFrame:
    """(domain, n, with_summary): obsolete messages by sender."""
    return scored.groupBy(text.domain(F.col("from_addr")).alias("domain")).agg(F.count("*").alias("n"), F.count("summary").alias("with_summary"))
