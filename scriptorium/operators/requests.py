"""Requests to a language model, and what comes back, as DataFrames. Calling the model is outside."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, routing, text


def prepare(sources: DataFrame, templates: Mapping[str, tuple[str, str]], models: Mapping[str, str], as_of: str, preference: str = "auto", max_tokens: int = 4096) -> DataFrame:
    """One request for each source (path, source_type, date, body): filled template, model by rules, token estimate.

    templates: (system, user) by source type, with {{path}}, {{date}}, {{body}}; sources of other types get none.
    """
    tier = routing.choose_tier(F.col("source_type"), F.length("body"), dates.age_days(dates.parse_day(F.col("date")), as_of), preference)
    values = {"path": F.col("path"), "date": F.col("date"), "body": F.col("body")}

    def fill(k: int) -> Column:
        out = F
        for kind, pair in templates.items():
            out = out.when(F.col("source_type") == kind, text.substitute(F.lit(pair[k]), values))
        return out

    model = F
    for name, value in models.items():
        model = model.when(F.col("tier.tier") == name, value)
    rows = sources.where(F.col("source_type").isin(*templates)).withColumn("tier", tier)
    return rows.select(
        text.short_id(F.col("path"), 16).alias("custom_id"),
        "source_type",
        F.col("path").alias("source_path"),
        fill(0).alias("system"),
        fill(1).alias("user"),
        model.alias("model"),
        F.col("tier.tier").alias("model_tier"),
        F.col("tier.reason").alias("model_reason"),
        F.lit(max_tokens).alias("max_tokens"),
    ).withColumn("estimated_tokens", F.expr("cast((length(system) + length(user)) div 4 AS long)"))


def ingest(results: DataFrame, requests: DataFrame) -> DataFrame:
    """results (custom_id, content, source_path) with `markdown`, `source` and `error`.

    The source is the content's own front matter field, else the result's, else the request's. Blank content is an error.
    """
    r = requests.select(F.col("custom_id").alias("__id"), F.col("source_path").alias("__path"))
    rows = results.join(r, F.col("custom_id") == F.col("__id"), "left").withColumn("markdown", text.unfenced(F.col("content")))
    source = F.coalesce(text.front_matter_field(F.col("markdown"), "source"), F.col("source_path"), F.col("__path"))
    blank = F.col("content").isNull() | (F.trim("content") == "")
    error = F.when(blank, "no_content").when(source.isNull(), "no_source")
    return rows.select("custom_id", F.when(~blank, F.col("markdown")).alias("markdown"), source.alias("source"), error.alias("error"))


def block_text(content: Column) -> Column:
    """The text of content given as JSON blocks [{type, text}], or as it is."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    return F.when(content.rlike(r"\A\s*\[\s*\{"), joined).otherwise(content)


#: What a context says where there is nothing.
NO_FILE, NO_SUMMARY = "(none yet)", "(no summary)"


def entity_context(summaries: DataFrame, k: int = 40, max_chars: int = 1200) -> DataFrame:
    """(entity, n, context): the k latest compact summaries of each entity, newest first, undated ones last.

    summaries: entity, date, path, fields (map of front matter), body. Not more than k summaries of an entity are held.
    """
    from .windows import recent_per_group

    rows = recent_per_group(summaries, "entity", "date", "path", k)
    part = F.concat(F.lit("### "), F.col("path"), F.lit("\n\n"), text.compact_summary(F.coalesce("fields", F.create_map().cast("map<string,string>")), F.col("body"), max_chars))
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("context"))


def entity_requests(entities: DataFrame, contexts: DataFrame, existing: DataFrame, candidates: DataFrame, template: tuple[str, str], model: str) -> DataFrame:
    """One request for each entity: custom_id, entity, system, user, model, estimated_tokens.

    contexts: entity_context(); existing: entity, profile, timeline (texts as they are); candidates: entity, aliases,
    relations (JSON). The template reads {{entity}}, {{profile}}, {{timeline}}, {{aliases}}, {{relations}} and {{summaries}}.
    """
    rows = entities.select("entity").distinct().join(contexts, "entity", "left").join(existing, "entity", "left").join(candidates, "entity", "left")
    values = {
        "entity": F.col("entity"),
        "profile": F.coalesce(F.nullif("profile", F.lit("")), F.lit(NO_FILE)),
        "timeline": F.coalesce(F.nullif("timeline", F.lit("")), F.lit(NO_FILE)),
        "aliases": F.coalesce("aliases", F.lit("[]")),
        "relations": F.coalesce("relations", F.lit("[]")),
        "summaries": F.coalesce("context", F.lit(NO_SUMMARY)),
    }
    out = rows.select(text.short_id(F.concat(F.lit("entity:"), F.col("entity")), 16).alias("custom_id"), "entity", F.lit(template[0]).alias("system"), text.substitute(F.lit(template[1]), values).alias("user"), F.lit(model).alias("model"))
    return out.withColumn("estimated_tokens", F.expr("cast((length(system) + length(user)) div 4 AS long)"))
