"""Manifests: building, enriching, patching and applying them as plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing, text
from .joins import resolve_aliases

STATUSES = ("auto", "alias_match", "to_confirm")


def build(summaries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows for summaries that aren't filed yet: name, routing and status. Name is resolved before sender.

    summaries: source, resume_path, entity_type, entity_slug, entity_name, sender, confidence, date, title.
    """
    rows = resolve_aliases(summaries, aliases, "entity_name").withColumnRenamed("entity", "__by_name")
    rows = resolve_aliases(rows, aliases, "sender").withColumnRenamed("entity", "__by_sender")
    alias = F.coalesce("__by_name", "__by_sender")
    status = routing.manifest_status(F.col("confidence"), F.col("entity_type"), F.col("entity_slug"), alias)
    stem = F.regexp_extract("resume_path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    named = (F.coalesce("date", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    return rows.select(
        "source",
        "resume_path",
        F.when(status == "alias_match", F.split_part(alias, F.lit("/"), F.lit(1))).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(status == "alias_match", F.substring(alias, F.locate("/", alias) + 1, F.length(alias))).otherwise(F.col("entity_slug")).alias("entity_slug"),
        "entity_name",
        F.when(named, text.file_name(F.col("date"), F.col("title"))).otherwise(stem).alias("new_name"),
        "confidence",
        status.alias("status"),
    )


def counts(manifest: DataFrame) -> DataFrame:
    """(status, n) with a row `total`."""
    rows = manifest.groupBy("status").agg(F.count("*").alias("n"))
    return rows.unionByName(manifest.agg(F.count("*").alias("n")).select(F.lit("total").alias("status"), "n"))


def enrich(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (id, candidates) attached to rows still to confirm."""
    c = candidates.select(F.col("id").alias("__id"), F.col("candidates").alias("__c"))
    old = F.col("candidates") if "candidates" in manifest.columns else F.lit(None)
    out = manifest.join(c, F.col("resume_path") == F.col("__id"), "left")
    return out.withColumn("candidates", F.when((F.col("status") == "to_confirm") & F.col("__id").isNotNull(), F.col("__c")).otherwise(old)).drop("__id", "__c")


def patch(rows: DataFrame, key: str, patches: DataFrame | None = None, where: Mapping[str, str] | None = None, put: Mapping[str, str] | None = None, delete_where: Mapping[str, str] | None = None) -> DataFrame:
    """Three steps in order: patches by key, then a filter with fields to set, then a filter of rows to delete.

    patches: id, changes (map of strings), remove (boolean), ord. Of one id the later wins field by field; a removal wins.
    Filters compare fields as strings; a null field reads 'None'.
    """

    def holds(filters: Mapping[str, str]):
        out = F.lit(True)
        for name, value in filters.items():
            out = out & (F.coalesce(F.col(name).cast("string"), F.lit("None")) == value)
        return out

    kinds = dict(rows.dtypes)
    if patches is not None:
        ordered = F.array_sort(F.collect_list(F.struct("ord", "changes")), lambda a, b: (a["ord"] - b["ord"]).cast("int"))
        by_id = patches.groupBy(F.col("id").alias("__id")).agg(F.max("remove").alias("__remove"), ordered.alias("__list"))
        merged = F.aggregate("__list", F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(F.coalesce(x["changes"], F.create_map().cast("map<string,string>")), k)), F.coalesce(x["changes"], F.create_map().cast("map<string,string>"))))
        by_id = by_id.withColumn("__set", merged).drop("__list")
        rows = rows.join(by_id, F.col(key).cast("string") == F.col("__id").cast("string"), "left").where("NOT coalesce(__remove, false)")
        changed = lambda c: F.coalesce(F.map_contains_key("__set", c), F.lit(False))
        rows = rows.select(*(F.when(changed(c), F.try_element_at("__set", F.lit(c)).cast(kind)).otherwise(F.col(c)).alias(c) for c, kind in kinds.items()))
    if where is not None and put:
        hit = holds(where)
        rows = rows.select(*(F.when(hit, F.lit(put[c]).cast(kind)).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c, kind in kinds.items()))
    return rows.where(~holds(delete_where)) if delete_where is not None else rows


def apply_plan(manifest: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """(action, src, dst, reason) for each row: move, or skip without routing, without confirmation or if the target exists."""
    target = F.concat_ws("/", F.lit(root), F.initcap("source"), "entity_type", "entity_slug", F.concat(F.col("new_name"), F.lit(".md")))
    whole = (F.coalesce("entity_type", F.lit("")) != "") & (F.coalesce("entity_slug", F.lit("")) != "")
    rows = manifest.withColumn("dst", F.when(whole, target)).join(existing.select(F.col("path").alias("__p")).distinct(), F.col("dst") == F.col("__p"), "left")
    reason = F.when(~F.col("status").isin("auto", "alias_match"), "not_confirmed").when(~whole, "no_routing").when(F.col("__p").isNotNull(), "target_exists")
    return rows.select(F.when(reason.isNull(), "move").otherwise("skip").alias("action"), F.col("resume_path").alias("src"), "dst", reason.alias("reason"))


def require(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails early if a manifest lacks a column."""
    if lacking := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"manifest lacks {', '.join(lacking)}")
    return rows
