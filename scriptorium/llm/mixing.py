"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are cut into blocks of `block_docs`. The targets are exact: while sources have blocks left, each
slot is shared among them in proportion to their weights, as rational numbers without rounding, and a source that ends
leaves its share to the others. Block i of a source (from 0) has as release the slot in which its target passes i, and as
deadline the one in which it reaches i + 1; at each slot, of the blocks released, the one of earliest deadline goes next.
The windows hold no more work than slots, so all deadlines are met: after any number of slots, over the whole schedule,
each source has within one block of its target.

The target of a source of weight w and n blocks at virtual time v is min(n, w * v), and the slot is the sum of these over
all sources. Of that, with D blocks of sources that have ended and weights W of the others, slot = D + W * v: one exact
division for a block.

Each slot depends on the one before, so one task of an executor makes the whole schedule in a stream and holds an entry for
each source only; its cost is some microseconds for a block, and larger blocks make it cheaper. The driver holds one
row for each source: its name, weight and number of blocks. Neither sees documents.

Documents get their number within the source from hash buckets of about `bucket_docs` rows: counts of buckets are summed
up, and rows are numbered inside a bucket. A hot source just has more buckets. Rows equal in doc_id, source and text are
counted first and numbered together, so that they make no bucket hot.

Every row is placed exactly once: nothing is dropped or repeated. Defined results: a null source is a source of its
own, named by null; null ids are ids. Sources without a target share the least weight given (or equal weights if none is
given); targets without documents are ignored. Weights must be positive. Rows that repeat are placed each on its own.
Empty tables give empty results. Texts only count by their hash. Extra columns are ignored by positions() and kept by mixed()
and with_places(), where rows equal in doc_id, source and text share the least of their places.

mixed() and with_places() shuffle each text once, at any size. with_places() merges texts and places by hash. mixed() must deal
texts by their place, which no row knows by itself; but within a source places rise with the draw, so the first draw of
each source in each partition (`cuts`) tells a row its partition, and there it meets its place.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import BROADCAST_BYTES, by_checked_size, materialise, ship
from .common import copies

BLOCK_DOCS = 16
BUCKET_DOCS = 4096
#: Bytes of one cut as it is broadcast, at most; where cuts would pass the bound on broadcasts, texts are shuffled twice.
CUT_BYTES = 64
#: Slots in a batch that the scheduling task hands on.
SLOTS = 1 << 16


@dataclass(frozen=True)
class Targets:
    """Sources with blocks, in the order in which they end; weights as integers without a common divisor."""

    names: tuple[str | None, ...]
    weights: tuple[int, ...]
    blocks: tuple[int, ...]
    ended: tuple[int, ...]  # ended[k]: blocks of the first k sources
    rates: tuple[int, ...]  # rates[k]: weights of the others

    @property
    def slots(self) -> int:
        return self.ended[-1]

    def reached(self, k: int, i: int, at: int = 0) -> tuple[int, int, int]:
        """The slot, rounded down and up, in which source k's target is i; and how many sources have ended then, `at` or more."""
        end, w = k, self.weights[k]
        while at < end:  # k itself ends at or after this
            mid = (at + end) // 2
            if self.blocks[mid] * w <= i * self.weights[mid]:
                at = mid + 1
            else:
                end = mid
        down, rest = divmod(self.rates[at] * i, w)
        return self.ended[at] + down, self.ended[at] + down + (rest > 0), at

    def order(self) -> Iterator[tuple[int, int]]:
        """(source, block) of each slot: earliest deadline first among the blocks released."""
        n = len(self.names)
        done, after, ends = [0] * n, [0] * n, [0] * n
        ready: list[tuple[int, int]] = []  # (deadline, source): one entry for each source, its next block
        later: list[tuple[int, int, int]] = []
        for k in range(n):
            after[k], deadline, ends[k] = self.reached(k, 1)
            ready.append((deadline, k))
        heapq.heapify(ready)
        for t in range(self.slots):
            while later and later[0][0] <= t:
                _, deadline, k = heapq.heappop(later)
                heapq.heappush(ready, (deadline, k))
            _, k = heapq.heappop(ready)
            yield k, done[k]
            done[k] += 1
            if done[k] < self.blocks[k]:
                release = after[k]
                after[k], deadline, ends[k] = self.reached(k, done[k] + 1, ends[k])
                heapq.heappush(later, (release, deadline, k))


def targets(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> Targets:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    left = {s: n for s, n in blocks.items() if n > 0}
    least = min((w for s, w in weights.items() if s in left), default=1.0)
    exact = {s: Fraction(weights.get(s, least)) for s in left}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    names = sorted(left, key=lambda s: (left[s] / exact[s], s is not None, s or ""))
    ws = [int(exact[s] * unit) for s in names]
    common = math.gcd(*ws) or 1
    ws = [w // common for w in ws]
    ns = [left[s] for s in names]
    return Targets(tuple(names), tuple(ws), tuple(ns), tuple(accumulate(ns, initial=0)), tuple(list(accumulate(reversed(ws), initial=0))[::-1]))


def plan(spark: SparkSession, of: Targets) -> DataFrame:
    """(p_source, p_block, slot) for every block, as a table."""
    shared = spark.sparkContext.broadcast(of)  # a row for each source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            mine = shared.value
            slots = mine.order()
            for at in range(0, mine.slots, SLOTS):
                rows = list(islice(slots, SLOTS))
                columns = [pa.array([mine.names[k] for k, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.int64()), pa.array(range(at, at + len(rows)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["p_source", "p_block", "slot"])

    return materialise(spark.range(0, 1, 1, 1).mapInArrow(run, "p_source string, p_block long, slot long"), "plan")


def source_sizes(docs: DataFrame) -> dict[str | None, int]:
    """Rows by source: one entry for each source reaches the driver."""
    return {r["source"]: r["n"] for r in docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n")).toLocalIterator()}


def _text_key(docs: DataFrame):
    return F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")


def _draw(doc_id, h):
    return F.xxhash64(doc_id, h, F.lit("mix"))


def numbered(docs: DataFrame, sizes: Mapping[str | None, int], bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(doc_id, source, h, same, nth): distinct rows, how often each occurs, and its number (from 0) in the source; a row that
    occurs n times has n numbers from nth on. The order is drawn by hash and is the same however the rows are stored."""
    spark = docs.sparkSession
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _text_key(docs).alias("h"))
    keys = keys.groupBy("doc_id", "source", "h").agg(F.count("*").alias("same")).withColumn("draw", _draw("doc_id", "h"))
    buckets = spark.createDataFrame([(s, -(-n // bucket_docs)) for s, n in sizes.items()], "s string, buckets long")
    keys = keys.join(by_checked_size(buckets, len(sizes), 256), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    place = F.floor((F.shiftrightunsigned("draw", 1) / F.lit(float(1 << 63))) * F.col("buckets")).cast("long")
    keys = materialise(keys.select("doc_id", "source", "h", "same", "draw", F.least(place, F.col("buckets") - 1).alias("bucket")), "draws")
    counts = keys.groupBy("source", "bucket").agg(F.sum("same").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum("n").over(before(Window.partitionBy("source").orderBy("bucket")))  # a row for each bucket
    offsets = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(earlier, F.lit(0)).alias("offset"))
    inside = F.sum("same").over(before(Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "h")))
    placed = keys.withColumn("i", F.coalesce(inside, F.lit(0))).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("doc_id", "source", "h", "same", (F.col("offset") + F.col("i")).cast("long").alias("nth"))


def _positioned(rows: DataFrame, sizes: Mapping[str | None, int], weights: Mapping[str | None, float], block_docs: int) -> DataFrame:
    """rows (source, nth, ...) with block, slot and position."""
    table = plan(rows.sparkSession, targets({s: -(-n // block_docs) for s, n in sizes.items()}, weights))
    rows = rows.withColumn("block", F.floor(F.col("nth") / block_docs).cast("long"))
    out = rows.join(table, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    return out.withColumn("position", F.col("slot") * block_docs + F.col("nth") % block_docs).drop("p_source", "p_block")


def tempered(sizes: Mapping[str | None, int], power: float = 0.7) -> dict[str | None, float]:
    """Default targets: a source of n documents weighs n ** power, so large sources count less than their share."""
    return {s: float(n) ** power for s, n in sizes.items()}


def positions(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block (from 0 in the source), slot (of the whole schedule), position (a total order of rows)."""
    ship(docs.sparkSession)
    sizes = source_sizes(docs)
    rows = copies(numbered(docs, sizes), "same", "copy").withColumn("nth", F.col("nth") + F.col("copy"))
    out = _positioned(rows, sizes, weights or tempered(sizes), block_docs)
    return out.select("doc_id", "source", "block", "slot", "position")


def places(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> tuple[DataFrame, int]:
    """(__mix_id, __mix_source, __mix_text, __mix_at) as a table, and the end of all positions.

    A row's place follows from doc_id, source and text alone, so the same rows have the same places however they are stored.
    """
    ship(docs.sparkSession)
    sizes = source_sizes(docs)
    out = _positioned(numbered(docs, sizes), sizes, weights or tempered(sizes), BLOCK_DOCS)
    out = materialise(out.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("h").alias("__mix_text"), F.col("position").alias("__mix_at")), "places")
    return out, sum(-(-n // BLOCK_DOCS) for n in sizes.values()) * BLOCK_DOCS


def _placed(rows: DataFrame, text_key, order: DataFrame, *also) -> DataFrame:
    on = rows["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")) & (text_key == F.col("__mix_text")) & rows["source"].cast("string").eqNullSafe(F.col("__mix_source"))
    for x in also:
        on = on & x
    # Never a broadcast: small runs take the path that large ones take.
    return rows.hint("merge").join(order.hint("merge"), on).drop("__mix_id", "__mix_source", "__mix_text")


def _slice(draw, parts: int):
    """The leading bits of a draw, so many that some eight of `parts` are met in a slice. A slice has draws of one sign."""
    return F.shiftrightunsigned(draw, 64 - max(1, (parts // 8).bit_length()))


def cuts(order: DataFrame, parts: int) -> DataFrame:
    """(source, slice, part, first) as a table: the first row, by draw, of each part within a slice of a source's draws.

    order: places with __mix_part. Numbers within a source, and so places and parts, rise with (draw, doc_id, h) in a slice.
    """
    drawn = order.withColumn("draw", _draw("__mix_id", "__mix_text"))
    first = F.min(F.struct("draw", F.col("__mix_id").alias("doc_id"), F.col("__mix_text").alias("h"))).alias("first")
    return materialise(drawn.groupBy(F.col("__mix_source").alias("source"), _slice("draw", parts).alias("slice"), F.col("__mix_part").alias("part")).agg(first), "cuts")


def _with_part(docs: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """docs and __mix_to, the partition of each row: in its slice the last whose first row is not after it."""
    lists = F.broadcast(found.groupBy(F.col("source").alias("__mix_s"), F.col("slice").alias("__mix_slice")).agg(F.collect_list(F.struct("part", "first")).alias("__mix_cuts")))
    draw = _draw(docs["doc_id"].cast("long"), _text_key(docs))
    key = F.struct(draw.alias("draw"), docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs).alias("h"))
    near = docs.join(lists, docs["source"].cast("string").eqNullSafe(F.col("__mix_s")) & (_slice(draw, parts) == F.col("__mix_slice")))
    begun = F.filter("__mix_cuts", lambda c: c["first"] <= key)
    return near.withColumn("__mix_to", F.array_max(F.transform(begun, lambda c: c["part"]))).drop("__mix_s", "__mix_slice", "__mix_cuts")


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """All rows of docs with their columns, in mixed order: dealt to partitions and sorted by their place in the schedule.

    A table written of it is not read back in that order; with_places() gives the place as a column.
    """
    order, end = places(docs, weights)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.expr(f"CAST(__mix_at * {parts}L DIV {max(1, end)}L AS int)")  # places are dense: equal ranges have equal rows
    order = order.withColumn("__mix_part", part)
    found = cuts(order, parts)
    if found.count() * CUT_BYTES <= BROADCAST_BYTES:
        dealt = _with_part(docs, found, parts).repartitionById(parts, F.col("__mix_to"))
        placed = _placed(dealt, _text_key(dealt), order.repartitionById(parts, F.col("__mix_part")), F.col("__mix_to") == F.col("__mix_part"))
    else:
        placed = _placed(docs, _text_key(docs), order).repartitionById(parts, F.col("__mix_part"))
    return placed.sortWithinPartitions("__mix_at").drop("__mix_at", "__mix_part", "__mix_to")


def with_places(rows: DataFrame, docs: DataFrame, text_key: str, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """All columns of rows but text_key, and `position`: the place in the schedule of docs. rows: doc_id, source, text_key
    (xxhash64 of the text) and others, a row for each row of docs."""
    order, _ = places(docs, weights)
    return _placed(rows, rows[text_key], order).withColumnRenamed("__mix_at", "position").drop(text_key)


def mixing_query(docs: DataFrame) -> DataFrame:
    """doc_id, source, block, slot, position: one row for each row of docs."""
    return positions(docs)
