"""Rejection chains: one CASE each; the first rule that hits is the reason, null means kept."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, scoring


def _glob(pattern: str) -> str:
    """A file-name glob as a regular expression."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    return text.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")") if prefixes else F.lit(False)


def part_matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether a component of the path matches a glob."""
    return path.rlike("(?:^|/)(?:" + "|".join(map(_glob, globs)).replace(".*", "[^/]*") + ")(?:/|$)") if globs else F.lit(False)


def document_reason(path: Column, extensions: Sequence[str] = (), technical: Sequence[str] = (), included: Sequence[str] = (), excluded: Sequence[str] = (), globs: Sequence[str] = (), in_range: Column | None = None) -> Column:
    """extension, technical_folder, workflow_folder, excluded_folder, excluded_pattern, out_of_range. Included folders override exclusions."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    chosen = starts_with_any(path, included)
    out = F.when(~extension.isin(*[e.lower() for e in extensions]), "extension") if extensions else F.when(F.lit(False), "")
    out = out.when(part_matches(path, technical), "technical_folder").when(path.startswith("- "), "workflow_folder")
    out = out.when(~chosen & starts_with_any(path, excluded), "excluded_folder").when(~chosen & part_matches(path, globs), "excluded_pattern")
    return out.when(~in_range, "out_of_range") if in_range is not None else out


def mail_reason(date: Column, score: Column, reasons: Column, rules: scoring.Rules, since: str | None = None, until: str | None = None) -> Column:
    """undated or out_of_range if a bound is given, then the score with its first three signals."""
    bounded = F.lit(since is not None or until is not None)
    low = F.concat(F.lit("score "), score.cast("string"), F.lit(": "), F.array_join(F.slice(F.split(reasons, ";"), 1, 3), ";"))
    return F.when(bounded & date.isNull(), "undated").when(~dates.in_range(date, since, until), "out_of_range").when(score <= rules.ignore, low)


def note_reason(path: Column, ignored: Sequence[str], created: Column, modified: Column, mtime: Column, since: str | None = None, until: str | None = None) -> Column:
    """ignored_folder:<name>, then out_of_range by front-matter dates, or by mtime without them."""
    hit = F.get(F.array_intersect(F.split(path, "/"), F.array(*map(F.lit, ignored))), F.lit(0)) if ignored else F.lit(None).cast("string")
    dated = created.isNotNull() | modified.isNotNull()
    ok = F.when(dated, dates.any_in_range([created, modified], since, until)).otherwise(dates.any_in_range([mtime], since, until))
    return F.when(hit.isNotNull(), F.concat(F.lit("ignored_folder:"), hit)).when(~ok, "out_of_range")


def kept_attachments(attachments: Column, extensions: Sequence[str], min_image: int = 50_000, images: bool = True) -> Column:
    """Attachments of an allowed extension; images only from a size on, or not at all."""
    image = ("png", "jpg", "jpeg", "gif", "webp", "heic")

    def keep(a: Column) -> Column:
        extension = F.lower(F.substring_index(a["filename"], ".", -1))
        picture = extension.isin(*image)
        return a["filename"].contains(".") & (extension.isin(*extensions) | picture) & (~picture | (F.lit(images) & (a["size"] >= min_image)))

    return F.filter(attachments, keep)


def trackable(path: Column) -> Column:
    """Not a name that begins with _, not under Attachments."""
    return ~F.substring_index(path, "/", -1).startswith("_") & ~path.rlike("(?:^|/)Attachments(?:/|$)")


def is_excluded(path: Column, included: Sequence[str], excluded: Sequence[str], globs: Sequence[str]) -> Column:
    return ~starts_with_any(path, included) & (starts_with_any(path, excluded) | part_matches(path, globs))


def by_domain_or_entity(rows: DataFrame, domains: Sequence[str] = (), entity: str | None = None) -> DataFrame:
    """Rows of some sender domains, and under one entity's folder."""
    if domains:
        rows = rows.where(F.lower("domain").isin(*[d.lower() for d in domains]))
    return rows.where(F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains(f"/{entity}/")) if entity else rows


def where_equal(rows: DataFrame, **fields: str) -> DataFrame:
    """Rows whose fields read as given; a null field reads 'None'."""
    out = rows
    for name, value in fields.items():
        out = out.where(F.coalesce(F.col(name).cast("string"), F.lit("None")) == value)
    return out


def processed(items: DataFrame, journal: DataFrame, operation: str) -> DataFrame:
    """items (id) that a successful journal row names: as source, as target, or within its details in any ASCII case."""
    done = journal.where((F.col("operation") == operation) & (F.col("status") == "success"))
    ends = done.select(F.col("source_path").alias("id")).unionByName(done.select(F.col("dest_path").alias("id"))).where("id IS NOT NULL").distinct()
    words = done.select(F.explode(F.regexp_extract_all(F.lower("details"), F.lit(r"""([^\s"{}\[\],:]+)"""), 1)).alias("word")).distinct()
    return items.join(ends, "id", "left_semi").unionByName(items.join(words, F.lower("id") == F.col("word"), "left_semi")).distinct()


def known_ids(items: DataFrame, files: DataFrame) -> DataFrame:
    return items.join(files.select(F.trim("message_id").alias("k")).distinct(), F.trim("message_id") == F.col("k"), "left_semi")
