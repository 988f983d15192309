"""Command line: `python -m scriptorium.cli <verb> ...`. Every verb prints JSON lines; verbs that change files only print their plan unless --apply is given."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import routing, scoring, text
from .operators import aggregates, dedup, inventory, joins, state
from .plans import builders, executor
from .sources import markdown, mbox

Verb = Callable[[SparkSession, argparse.Namespace], DataFrame | dict]
VERBS: dict[str, tuple[Verb, tuple[str, ...]]] = {}


def verb(name: str, *options: str) -> Callable[[Verb], Verb]:
    """A verb with the options it reads, beside those of all."""

    def add(f: Verb) -> Verb:
        VERBS[name] = (f, options)
        return f

    return add


def _mail(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    spark.dataSource.register(mbox.MboxSource)
    reader = spark.read.format("mbox")
    for k in ("since", "until"):
        if getattr(a, k):
            reader = reader.option(k, getattr(a, k))
    return reader.load(",".join(mbox.mail_files(a.path, a.folder)))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path relative to the given one, size, mtime."""
    top = path.rstrip("/") + "/"
    return markdown.listing(spark, path).withColumn("path", F.substring_index("path", top, -1))


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """path relative to the given one, md: every Markdown file as text."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.substring_index("path", path.rstrip("/") + "/", -1).alias("path"), F.col("content").cast("string").alias("md"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@verb("mail list", "folder", "since", "until")
def mail_list(spark, a):
    return _mail(spark, a).select("message_id", "from_addr", "subject", F.col("date").cast("string").alias("date"), "folder")


@verb("mail score", "folder", "since", "until")
def mail_score(spark, a):
    return scoring.score_messages(_mail(spark, a), scoring.Rules()).select("message_id", "from_addr", "subject", "score", "reasons", "band")


@verb("mail bands", "folder", "since", "until")
def mail_bands(spark, a):
    return aggregates.band_shares(scoring.score_messages(_mail(spark, a), scoring.Rules()))


@verb("mail senders", "folder", "since", "until")
def mail_senders(spark, a):
    rows = scoring.score_messages(_mail(spark, a), scoring.Rules()).withColumn("domain", text.domain(F.col("from_addr")))
    return aggregates.domain_bands(rows)


@verb("mail threads", "folder", "since", "until")
def mail_threads(spark, a):
    from .operators import graph
    from .tables import materialise

    rows = _mail(spark, a).select("message_id", F.array_compact(F.concat(F.array("in_reply_to"), "references")).alias("parents"))
    return graph.threads(materialise(rows.withColumn("num", F.monotonically_increasing_id()), "mail"))


@verb("mail extract", "folder", "since", "until", "root")
def mail_extract(spark, a):
    there = _files(spark, a.root).select(F.concat(F.lit(a.root.rstrip("/") + "/"), "path").alias("path")) if a.known else _empty(spark, "path string")
    known = inventory.known_message_ids(_contents(spark, a.root), F.col("md")) if a.known else _empty(spark, "message_id string")
    return builders.extract(_mail(spark, a), scoring.Rules(), known, there, a.root, a.since, a.until)


@verb("notes copy", "root")
def notes_copy(spark, a):
    mirrors = _files(spark, a.root).select("path", "mtime") if a.known else _empty(spark, "path string, mtime timestamp")
    return builders.copy_notes(_files(spark, a.path).select("path", "mtime"), mirrors, a.path.rstrip("/"), a.root.rstrip("/"))


@verb("notes backlog", "root")
def notes_backlog(spark, a):
    mirrors = _files(spark, a.root).select("path", "mtime") if a.known else _empty(spark, "path string, mtime timestamp")
    return inventory.newer_notes(_files(spark, a.path), mirrors)


@verb("documents tables")
def documents_tables(spark, a):
    return markdown.suspicious(_contents(spark, a.path), "path", F.col("md"))


@verb("documents reindex")
def documents_reindex(spark, a):
    rows = _contents(spark, a.path)
    return inventory.reindexed(rows, F.col("md"), F.lit("transcription"), _empty(spark, "path string, size long, mtime timestamp, hash string"))


@verb("documents duplicates")
def documents_duplicates(spark, a):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.path).select("path", F.col("length").alias("size"), "content")
    crowded = dedup.size_twins(files.select("path", "size")).select("path")
    return builders.deduplicate(dedup.duplicates(files.join(crowded, "path", "left_semi"), F.sha2("content", 256)))


@verb("synthesis list")
def synthesis_list(spark, a):
    rows = inventory.latest_digests(_files(spark, a.path).withColumn("path", F.concat(F.lit("./"), "path")))
    return rows.select("kind", "nth", F.substring("path", 3, 10_000).alias("path"))


@verb("actions list", "day", "status", "entity")
def actions_list(spark, a):
    rows = _contents(spark, a.path).where(F.col("path").endswith("timeline.md")).withColumn("entity", F.regexp_replace("path", r"/[^/]*$", ""))
    out = markdown.actions(rows, "entity", F.col("md"), F.to_date("mtime"), a.day, a.status, a.entity)
    return out.withColumn("due", F.col("due").cast("string"))


@verb("attachments orphans")
def attachments_orphans(spark, a):
    files = _files(spark, a.path).where(F.col("path").contains("Attachments/")).select(F.regexp_replace("path", r"/?Attachments/[^/]*$", "").alias("dir"), F.substring_index("path", "/", -1).alias("name"), "size")
    refs = _contents(spark, a.path).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.explode(text.attachment_refs(F.col("md"))).alias("name"))
    plan = builders.clean_orphans(files, refs)
    return plan.withColumn("src", F.concat(F.lit(a.path.rstrip("/") + "/"), F.regexp_replace("src", r"([^/]+)$", "Attachments/$1")))


@verb("audit links")
def audit_links(spark, a):
    files = _files(spark, a.path).where(F.col("path").contains("Attachments/")).select(F.substring_index("path", "/", -1).alias("name"))
    refs = _contents(spark, a.path).select("path", F.explode(text.attachment_refs(F.col("md"))).alias("name"))
    return joins.broken_links(refs, files, "name").select("path", "name")


@verb("audit prune", "root")
def audit_prune(spark, a):
    stored = state.read(spark, a.root)
    return _empty(spark, "file_type string, n long") if stored is None else state.pruned_counts(stored, _files(spark, a.path))


@verb("scope directories")
def scope_directories(spark, a):
    return inventory.classified_directories(_files(spark, a.path), 3, ["pdf", "docx", "md"], ["py", "js", "ts"], ["png", "jpg", "jpeg"], [".git"], ["node_modules"])


@verb("summaries route", "day")
def summaries_route(spark, a):
    rows = _contents(spark, a.path)
    kind = F.coalesce(text.source_from_path(F.concat(F.lit("Transcriptions/"), "path")), F.lit("document"))
    tier = routing.choose_tier(kind, F.length(text.body(F.col("md"))), F.lit(None).cast("int"))
    return aggregates.reason_counts(rows.select(tier.alias("t")).select("t.tier", "t.reason"))


@verb("directories clean")
def directories_clean(spark, a):
    return {"removed": executor.remove_empty_directories(a.path, dry_run=not a.apply)}


@verb("config check")
def config_check(spark, a):
    return {"problems": scoring.problems(scoring.Rules())}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True, metavar="verb")
    for name, (_, options) in VERBS.items():
        p = verbs.add_parser(name.replace(" ", "-"))
        p.set_defaults(run=name)
        p.add_argument("path", help="the folder to read")
        p.add_argument("--apply", action="store_true", help="do what the plan says")
        p.add_argument("--limit", type=int, default=1000, help="rows to print at most; a plan is applied whole")
        for o in ("folder", "since", "until", "entity"):
            p.add_argument(f"--{o}") if o in options else p.set_defaults(**{o: None})
        p.add_argument("--root", required=True) if "root" in options else p.set_defaults(root=None)
        p.add_argument("--known", action="store_true", help="the root exists: leave out what is there") if "root" in options else p.set_defaults(known=False)
        p.add_argument("--day", required=True, help="the day that counts as today") if "day" in options else p.set_defaults(day=None)
        p.add_argument("--status", default="all") if "status" in options else p.set_defaults(status="all")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("scriptorium").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = VERBS[a.run][0](spark, a)
        if isinstance(out, dict):
            print(json.dumps(out, ensure_ascii=False))
            return 0
        if "action" in out.columns and a.apply:
            print(json.dumps(executor.apply(out, dry_run=False)))
            return 0
        for line in out.limit(a.limit).toJSON().toLocalIterator():
            print(line)
        return 0
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
