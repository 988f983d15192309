"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, materialise


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over a table of rows (u > v), which it replaces.

    Large star: each node hands the least node it sees, itself included, to its larger neighbours.
    Small star: each node hands the least of its smaller neighbours to the others and to itself.
    Minima are partial aggregates, so a hub costs one row for each task. They become a table before the join, whose two
    sides are then plain exchanges: the engine can split a hub's rows among tasks.
    """
    if larger_only:
        seen = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = materialise(seen.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least")), "least")
        moved = edges.join(least, edges["v"] == least["n"]).select("u", F.col("least").alias("v"))
    else:
        least = materialise(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least")), "least")
        moved = edges.join(least, edges["u"] == least["n"]).select("u", "v", "least")
        moved = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
    out = materialise(moved.where("u <> v").distinct(), "stars")
    discard(edges, least)
    return out


def _all_stars(edges: DataFrame) -> bool:
    """True if every node has one smaller neighbour at most and none has both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return bad.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge that isn't itself a root; root is the least node that it reaches.

    edges: two long columns; direction, repeats and loops don't matter; null ends are ignored. Only counts reach the driver.
    Rounds go on until every component is a star; each hands nodes to smaller ones only, so that they come to an end.
    """
    a, b = edges.columns[:2]
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    table = materialise(pairs.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges")
    while not _all_stars(table):
        table = _stars(_stars(table, True), False)
    return table.select(F.col("u").alias("node"), F.col("v").alias("root"))


def threads(messages: DataFrame) -> DataFrame:
    """(message_id, thread_id, size): messages joined by replies; thread_id is the least number of its messages.

    messages: num (long, unique), message_id, parents (array of ids: in-reply-to and references). Parents that are not among
    the messages are ignored, and so are messages without id. Of rows with one id, the largest num counts.
    """
    known = messages.where("message_id IS NOT NULL AND message_id <> ''").groupBy("message_id").agg(F.max(F.struct("num", "parents")).alias("m")).select("message_id", "m.num", "m.parents")
    known = materialise(known, "messages")
    asks = known.select(F.col("num").alias("child"), F.explode("parents").alias("parent_id"))
    edges = asks.join(known.select(F.col("num").alias("parent"), F.col("message_id").alias("parent_id")), "parent_id").select("child", "parent")
    roots = components(edges)
    out = known.join(roots, F.col("num") == F.col("node"), "left").select("message_id", F.coalesce("root", "num").alias("thread_id"))
    sizes = out.groupBy("thread_id").agg(F.count("*").alias("size"))
    return out.join(sizes, "thread_id").select("message_id", "thread_id", "size")


def thread_order(turns: DataFrame) -> DataFrame:
    """(thread_id, at, member, nth): a thread's messages in order of time, undated ones first, ties by member; nth from 1.

    One row for each message: a thread of any length spreads over as many rows, sorted externally within its partition.
    """
    order = Window.partitionBy("thread_id").orderBy(F.col("at").asc_nulls_first(), "member")
    return turns.select("thread_id", "at", "member", F.row_number().over(order).cast("long").alias("nth"))


def thread_summary(turns: DataFrame) -> DataFrame:
    """(thread_id, n, latest, first_member): a thread's size, its latest date, and the member of its earliest message."""
    first = F.min(F.struct(F.col("at").isNotNull().alias("dated"), "at", "member"))
    return turns.groupBy("thread_id").agg(F.count("*").alias("n"), F.max("at").alias("latest"), first.alias("f")).select("thread_id", "n", "latest", F.col("f.member").alias("first_member"))
