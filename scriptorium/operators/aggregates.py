"""Counts, sums and reports. Hot groups are pre-aggregated on the map side by partial aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_summary(usage: DataFrame, dimensions: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """One pass over grouping sets: the total and each dimension alone. `dimension` says which; `value` is null for the total."""
    rows = usage.select(*dimensions, *(c.alias(n) for n, c in sums.items()))
    groups = rows.groupingSets([[], *([F.col(d)] for d in dimensions)], *dimensions)
    out = groups.agg(*(F.grouping(d).alias(f"__{d}") for d in dimensions), F.count("*").alias("n"), *(F.sum(n).alias(n) for n in sums))
    level, value = F.lit("total"), F.lit(None).cast("string")
    for d in dimensions:
        level = F.when(F.col(f"__{d}") == 0, d).otherwise(level)
        value = F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return out.select(level.alias("dimension"), value.alias("value"), "n", *sums)


def hit_rate(read: Column, input_tokens: Column, write: Column) -> Column:
    """read / (input + write + read), 0 if nothing was read or written."""
    total = input_tokens + write + read
    return F.when(total > 0, read / total).otherwise(F.lit(0.0))


def zero_filled(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(column, n) for each of the values, also those without rows."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.where(F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duplicate_groups(rows: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, item, n): the members of groups of more than one, a row each. Null and empty keys don't count."""
    named = rows
    for k in keys:
        named = named.where(F.col(k).isNotNull() & (F.col(k).cast("string") != "") & (F.col(k).cast("string") != "<unknown>"))
    crowded = named.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return named.join(crowded, list(keys)).select(*keys, item, "n")


def moc_stale(summaries: DataFrame, pages: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """(key, newer, missing): categories without a page, or with at least `threshold` summaries newer than it."""
    page = pages.select(F.col(key).alias("__k"), F.col("at").alias("page_at"))
    joined = summaries.join(page, F.col(key) == F.col("__k"), "left")
    out = joined.groupBy(key).agg(F.count_if(F.col("at") > F.col("page_at")).alias("newer"), F.max(F.col("__k").isNull()).alias("missing"))
    return out.where((F.col("newer") >= threshold) | F.col("missing"))


def forecast(counts: DataFrame, prices: Mapping[str, str], batch: bool, others: int = 0, other_price: str = "0.05") -> DataFrame:
    """(kind, n, cost): counts x unit price, half in batch mode; unknown kinds cost nothing; then a row for the rest at full price. Exact decimals."""
    spark = counts.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in prices.items()], "kind string, price string").select("kind", F.col("price").cast("decimal(10,4)").alias("price"))
    factor = F.lit("0.5" if batch else "1").cast("decimal(2,1)")
    out = counts.join(F.broadcast(table), "kind", "left").select("kind", "n", (F.col("n").cast("decimal(18,0)") * F.coalesce("price", F.lit(0)) * factor).cast("decimal(18,4)").alias("cost"))
    rest = spark.range(1).select(F.lit("synthesis").alias("kind"), F.lit(others).cast("long").alias("n"), (F.lit(others).cast("decimal(18,0)") * F.lit(other_price).cast("decimal(10,4)")).cast("decimal(18,4)").alias("cost"))
    return out.unionByName(rest)


def folder_stats(rows: DataFrame, folder: str, size: Column) -> DataFrame:
    """(folder, n, size) for each folder and, with a null folder and is_total, for all."""
    measured = rows.select(F.col(folder).alias("folder"), size.alias("size"))
    return measured.rollup("folder").agg(F.grouping("folder").cast("int").alias("is_total"), F.count("*").alias("n"), F.sum("size").alias("size"))


def band_shares(scored: DataFrame) -> DataFrame:
    """(band, n, share): shares of all rows."""
    counts = scored.groupBy("band").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def tier_shares(choices: DataFrame) -> DataFrame:
    """(tier, n, share) of a routing."""
    counts = choices.groupBy("tier").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def reason_counts(choices: DataFrame) -> DataFrame:
    """(tier, reason, n): why models were chosen."""
    return choices.groupBy("tier", F.coalesce("reason", F.lit("?")).alias("reason")).agg(F.count("*").alias("n"))


def borderline(scored: DataFrame, capture: int, ignore: int, key: str, k: int = 10) -> DataFrame:
    """The k lowest captured of score <= capture + 1, and the k highest ignored of score >= ignore - 1; ties by key."""
    low = scored.where((F.col("band") == "captured") & (F.col("score") <= capture + 1)).orderBy("score", key).limit(k)
    high = scored.where((F.col("band") == "ignored") & (F.col("score") >= ignore - 1)).orderBy(F.desc("score"), key).limit(k)
    return low.select(F.lit("captured").alias("side"), key, "score").unionByName(high.select(F.lit("ignored").alias("side"), key, "score"))


def frequent(rows: DataFrame, column: str, least: int = 3, k: int = 5) -> DataFrame:
    """The k values with most rows, of those with `least` and more; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), column).limit(k)


def domain_bands(scored: DataFrame) -> DataFrame:
    """Per domain: rows of each band and the mean captured score."""
    captured = F.col("band") == "captured"
    return scored.groupBy("domain").agg(
        F.count("*").alias("n"),
        F.count_if(captured).alias("captured"),
        F.count_if(F.col("band") == "ignored").alias("ignored"),
        F.count_if(F.col("band") == "grey").alias("grey"),
        F.avg(F.when(captured, F.col("score"))).alias("mean_captured"),
    )


def sender_lists(bands: DataFrame, capture: int, skip: Sequence[str] = (), k: int = 20) -> DataFrame:
    """(list, domain, weight): candidates for the allow list, the deny list and review; the k of most rows each."""
    rows = bands.where(~F.col("domain").isin(*skip)) if skip else bands
    allow = rows.where("ignored >= 2 AND ignored / n > 0.5").select(F.lit("allow").alias("list"), "domain", F.col("ignored").alias("weight"))
    deny = rows.where((F.col("captured") >= 2) & (F.col("mean_captured") <= capture + 1)).select(F.lit("deny").alias("list"), "domain", F.col("captured").alias("weight"))
    review = rows.where("captured >= 1 AND ignored >= 1").select(F.lit("review").alias("list"), "domain", (F.col("captured") + F.col("ignored")).alias("weight"))
    top = lambda df: df.orderBy(F.desc("weight"), "domain").limit(k)
    return top(allow).unionByName(top(deny)).unionByName(top(review))


def alias_candidates(mentions: DataFrame, existing: DataFrame) -> DataFrame:
    """(alias, kind, support): names, addresses and *@domain of mentions that aren't known aliases.

    mentions: ord, name, address. The key is the trimmed lower-case text; the first spelling and kind count.
    """
    at = F.lower(F.regexp_replace(F.substring_index("address", "@", -1), ">.*$", ""))
    each = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("name").alias("kind"), F.trim("name").alias("alias")),
        F.struct(F.lit(1).alias("place"), F.lit("address").alias("kind"), F.trim("address").alias("alias")),
        F.struct(F.lit(2).alias("place"), F.lit("domain").alias("kind"), F.when(F.col("address").contains("@"), F.concat(F.lit("*@"), at)).alias("alias")),
    )
    rows = mentions.select("ord", F.explode(each).alias("m")).select("ord", "m.*").where("alias IS NOT NULL AND alias <> ''").withColumn("key", F.lower("alias"))
    rows = rows.join(existing.select(F.lower(F.trim("alias")).alias("key")).distinct(), "key", "left_anti")
    out = rows.groupBy("key").agg(F.min(F.struct("ord", "place", "alias", "kind")).alias("first"), F.count("*").alias("support"))
    return out.select("first.alias", "first.kind", "support")


def co_mentions(rows: DataFrame, group: str, item: str, least: int = 1, paths: int = 0) -> DataFrame:
    """(a, b, n): in how many groups two items occur together, a < b; with `paths`, also the least so many groups, in order.

    Items that occur in fewer than `least` groups can't be in a result and go first. Those of a group then meet by an
    equi-join on the group: distinct entities of one document, whose number a document bounds.
    """
    each = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g IS NOT NULL AND i IS NOT NULL").distinct()
    often = each.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("i")
    each = each.join(often, "i", "left_semi")
    pairs = each.select("g", F.col("i").alias("a")).join(each.select("g", F.col("i").alias("b")), "g").where("a < b")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if not paths:
        return out
    order = Window.partitionBy("a", "b").orderBy("g")
    first = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= paths).groupBy("a", "b").agg(F.array_sort(F.collect_list("g")).alias("paths"))  # `paths` at most
    return out.join(first, ["a", "b"])


def missing_fields(rows: DataFrame, key: str, fields: Column, required: Sequence[str]) -> DataFrame:
    """(key, missing): required fields that a map lacks or holds as null, sorted and joined."""
    present = F.map_keys(F.map_filter(fields, lambda _, v: v.isNotNull()))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce(present, F.array().cast("array<string>"))))
    return rows.select(key, F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def check_report(issues: Mapping[str, DataFrame]) -> DataFrame:
    """(check, issues, status): ok if a check found nothing."""
    out = None
    for name, frame in issues.items():
        row = frame.agg(F.count("*").alias("issues")).select(F.lit(name).alias("check"), "issues", F.when(F.col("issues") == 0, "ok").otherwise("issues").alias("status"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no checks given")
    return out


def config_diff(mine: DataFrame, template: DataFrame) -> DataFrame:
    """(key, change, mine, template): add, remove or set, of (key, value) rows."""
    a, b = mine.select("key", F.col("value").alias("mine")), template.select(F.col("key").alias("k"), F.col("value").alias("template"))
    out = a.join(b, F.col("key") == F.col("k"), "full")
    change = F.when(F.col("k").isNull(), "add").when(F.col("key").isNull(), "remove").when(~F.col("mine").eqNullSafe(F.col("template")), "set")
    return out.select(F.coalesce("key", "k").alias("key"), change.alias("change"), "mine", "template").where("change IS NOT NULL")


def scope_report(directories: DataFrame, included: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """(status, category, n, files): directories (path, category, files) by what the configuration says of them."""
    from .filters import starts_with_any

    status = F.when(starts_with_any(F.col("path"), included), "included").when(starts_with_any(F.col("path"), excluded), "excluded").otherwise("undecided")
    return directories.groupBy(status.alias("status"), "category").agg(F.count("*").alias("n"), F.sum("files").alias("files"))


def backlog(sources: DataFrame, mirrors: DataFrame, reason: Column) -> DataFrame:
    """(year, reason, n): sources (path, mirror, modified) without a mirror, by year; the rejected ones by reason. Metadata only."""
    todo = sources.withColumn("reason", reason).join(mirrors.select(F.col("path").alias("__m")).distinct(), F.col("mirror") == F.col("__m"), "left_anti")
    return todo.groupBy(F.year("modified").alias("year"), "reason").agg(F.count("*").alias("n"))


def tree_counts(files: DataFrame, documents: Sequence[str], code: Sequence[str], images: Sequence[str]) -> DataFrame:
    """Per directory of files (path): counts of kinds over everything below it; each file counts for all its ancestors."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parts = F.split("path", "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    up = F.transform(depths, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    kinds = files.select(F.explode(up).alias("dir"), extension.alias("e"), F.substring_index("path", "/", -1).alias("name"))
    return kinds.groupBy("dir").agg(
        F.count_if(F.col("e").isin(*documents)).alias("documents"),
        F.count_if(F.col("e").isin(*code)).alias("code"),
        F.count_if(F.col("e").isin(*images)).alias("images"),
        F.count("*").alias("total"),
        F.count_if(F.col("name").rlike("(?i)^(?:IMG_|DSC_|DCIM|DSCN|P10|GOPR)")).alias("photo_names"),
    )


def config_sizes(config: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """How many entries each list of a configuration has."""
    return {name: len(values) for name, values in config.items() if isinstance(values, list | tuple)}
