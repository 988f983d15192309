"""Classification by rules: model tiers, directory classes, statuses, prices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to which mail and notes are short, beyond which documents are long; days beyond which a source is old.
MAIL_SHORT, NOTE_SHORT, DOCUMENT_LONG, OLD_DAYS = 2000, 2500, 12000, 540

#: USD per million tokens (input, output) by tier, and what applies to unknown models.
PRICES: Mapping[str, tuple[float, float]] = {"small": (0.8, 4.0), "large": (3.0, 15.0)}
DEFAULT_PRICE = (3.0, 15.0)
#: Factors of the input price for writing to and reading from a prompt cache.
CACHE_WRITE, CACHE_READ = 1.25, 0.10


def choose_tier(kind: Column, length: Column, age: Column, preference: str = "auto") -> Column:
    """struct(tier, reason) for a source of a kind, a length in characters and an age in days (null: not old)."""
    old = F.coalesce(age > OLD_DAYS, F.lit(False))
    pick = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    small, large = (lambda r: pick("small", r)), (lambda r: pick("large", r))
    if preference == "auto":
        return (
            F.when((kind == "note") & (length <= NOTE_SHORT), small("short"))
            .when((kind == "mail") & (length <= MAIL_SHORT), small("short"))
            .when((kind == "document") & (length > DOCUMENT_LONG), large("long"))
            .when(kind.isin("note", "mail", "thread", "document") & old, small("old"))
            .when(kind.isin("digest", "moc"), small("mechanical"))
            .otherwise(large("default"))
        )
    if preference == "economy":
        return F.when((kind == "document") & (length > DOCUMENT_LONG), large("long")).when(kind == "thread", large("thread")).otherwise(small("economy"))
    if preference == "quality":
        return F.when((kind == "note") & (length <= NOTE_SHORT), small("short")).when(kind.isin("digest", "moc"), small("mechanical")).otherwise(large("quality"))
    raise ValueError(f"unknown preference {preference}")


def classify_directory(name: Column, has_marker: Column, documents: Column, code: Column, images: Column, total: Column, photo_names: Column) -> Column:
    """struct(category, confidence): the first rule that holds."""
    pick = lambda category, confidence: F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
    much_code = (total > 10) & (code > 0.5 * total)
    much_photo = (total > 10) & (images > 0.8 * total)
    return (
        F.when(name.rlike(r"(?i)\.(?:app|bundle|framework|photoslibrary|pkg|plugin)$"), pick("bundle", "high"))
        .when(has_marker & (documents > 0), pick("mixed_documents", "medium"))
        .when(has_marker, pick("code", "high"))
        .when(much_code & (documents > 0), pick("mixed_documents", "medium"))
        .when(much_code, pick("code", "medium"))
        .when(much_photo & ((photo_names > 3) | F.lower(name).isin("photos", "camera roll", "souvenirs")), pick("photos", "high"))
        .when(much_photo, pick("photos", "low"))
        .when(documents > 0, pick("documents", "high"))
        .when(total == 0, pick("empty", "high"))
        .otherwise(pick("other", "low"))
    )


def guess_category(name: Column, has_marker: Column, code: Column, total: Column) -> Column:
    """A directory's category from its own entries only; null if unclear."""
    return F.when(name.rlike(r"(?i)\.(?:app|bundle|framework|photoslibrary|pkg|plugin)$"), "bundle").when(has_marker, "code").when((total > 3) & (code > 0.5 * total), "code")


def has_code_marker(children: Column, markers: tuple[str, ...] = (".git", "package.json", "pyproject.toml", "Cargo.toml", "*.xcodeproj")) -> Column:
    """Whether a child is a marker, or ends like a marker that begins with *."""
    exact = [m for m in markers if not m.startswith("*")]
    ends = "|".join(m[1:].replace(".", r"\.") for m in markers if m.startswith("*"))
    return F.exists(children, lambda c: c.isin(*exact) | (c.rlike(f"(?:{ends})$") if ends else F.lit(False)))


def manifest_status(confidence: Column, entity_type: Column, entity_slug: Column, alias: Column) -> Column:
    """auto if the routing is sure and whole, alias_match if an alias resolves it, else to_confirm."""
    sure = (confidence == "high") & (entity_type != "unknown") & (F.coalesce(entity_type, F.lit("")) != "") & (F.coalesce(entity_slug, F.lit("")) != "")
    return F.when(sure, "auto").when(alias.isNotNull(), "alias_match").otherwise("to_confirm")


def action_status(due: Column, touched: Column, as_of: str, idle_days: int = 90) -> Column:
    """expired if overdue, or without a due date and untouched for idle_days; else open."""
    day = F.lit(as_of).cast("date")
    return F.when(due < day, "expired").when(due.isNull() & (F.datediff(day, touched) > idle_days), "expired").otherwise("open")


def token_cost(model: Column, input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column, prices: Mapping[str, tuple[float, float]] = PRICES) -> Column:
    """USD, unrounded; unknown models at the default price, null counters as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))

    def price(k: int) -> Column:
        out = F
        for name, p in prices.items():
            out = out.when(model == name, p[k])
        return out.otherwise(DEFAULT_PRICE[k])

    return ((zero(input_tokens) + zero(cache_write) * CACHE_WRITE + zero(cache_read) * CACHE_READ) * price(0) + zero(output_tokens) * price(1)) / 1_000_000


#: Words of a comment over a list that name the category of its entries.
SECTIONS = (("code", "code"), ("photo", "photos"), ("app", "bundle"), ("bundle", "bundle"))


def section_category(lines: list[str], entry: str, reach: int = 4) -> str | None:
    """The category that the nearest comment above a list entry names; None if the entry is missing, or no comment is near.

    lines: those of a configuration file; its list entries begin with "- ". Only `reach` lines are looked at.
    """
    at = next((i for i, line in enumerate(lines) if line.strip().startswith("- ") and line.strip()[2:].strip("\"' ") == entry), None)
    if at is None:
        return None
    for line in reversed(lines[max(0, at - reach) : at]):
        comment = line.strip().lower()
        if comment.startswith("#"):
            for word, category in SECTIONS:
                if word in comment:
                    return category
    return None
