"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits are cut into four segments of 16. Two that differ in at most two bits agree in three segments,
or differ by one bit in each of two. Four tables hold every distinct fingerprint under the 48 bits that remain when
one segment is left out. A lookup takes each fingerprint's own 48 bits, and for each two segments the ball of radius
one around the first with the second left out. Of two fingerprints that differ at a bit one has 0 there, so only
flips from 0 to 1 are looked up: 4 + 48 lookups on average. Whole fingerprints of all matches are then compared.

With 48 bits under each key, no key can hold more than 65,536 fingerprints however many documents there are, so
there are no hot buckets and no caps. Equal fingerprints meet before the search and count once. Links go to an
iterative component search as a table.

Defined results: null texts count as empty; texts without a word get fingerprint zero, which links like any other.
A null doc_id never names a component unless all of a component's ids are null. Repeated rows get one row each, and rows that
share a doc_id but not their text are told apart by a hash of the text. Empty tables give empty results. Extra columns are
ignored by classes() and kept by survivors().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..tables import by_checked_size, materialise, ship
from .common import text_or_empty

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
SEGMENTS, SEGMENT_BITS = 4, 16
#: Shingles hashed at a time: bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six ASCII blanks split
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - SHINGLE_WORDS])).tolist()
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts), bitorder="little").tobytes(), "little")


def _text_hash():
    return F.xxhash64(text_or_empty())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) for each row: a hash of the text, and the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def _key(table: int, fp: str) -> str:
    """SQL: the table's number above the 48 bits of fp outside segment `table`."""
    low = SEGMENT_BITS * table
    above = f"shiftleft(shiftrightunsigned({fp}, {low + SEGMENT_BITS}), {low})" if table < SEGMENTS - 1 else "0L"
    below = f"({fp} & {(1 << low) - 1}L)"
    return f"({above} | {below} | {table << 48}L)"


def _key_of(table: str, fp: str) -> str:
    return f"CASE {table} " + " ".join(f"WHEN {t} THEN {_key(t, fp)}" for t in range(SEGMENTS)) + " END"


def lookups() -> list[tuple[int, int]]:
    """(table, bit to set): the exact keys with bit -1, then the balls of radius one."""
    return [(t, -1) for t in range(SEGMENTS)] + [(j, b) for i, j in combinations(range(SEGMENTS), 2) for b in range(SEGMENT_BITS * i, SEGMENT_BITS * (i + 1))]


def links(nodes: DataFrame) -> DataFrame:
    """nodes: distinct (fp, node). (a, b): nodes whose fingerprints differ in one or two bits."""
    tries = "array(" + ", ".join(f"named_struct('t', {t}, 'm', shiftleft({min(1, bit + 1)}L, {max(bit, 0)}))" for t, bit in lookups()) + ")"
    asks = nodes.select("fp", "node", F.expr(f"explode({tries}) AS x")).where("(fp & x.m) = 0L")
    asks = asks.selectExpr(f"{_key_of('x.t', '(fp | x.m)')} AS key", "fp", "node", "x.m = 0L AS plain")
    held = nodes.select("fp", "node", F.expr("explode(array(0, 1, 2, 3)) AS t")).selectExpr(f"{_key_of('t', 'fp')} AS k", "fp AS other_fp", "node AS other")
    near = (F.col("key") == F.col("k")) & (F.col("fp") != F.col("other_fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= MAX_DISTANCE) & (~F.col("plain") | (F.col("fp") < F.col("other_fp")))
    # Never a broadcast: the engine's estimate of either side is that of nodes, before they are exploded.
    return asks.hint("merge").join(held.hint("merge"), near).select(F.col("node").alias("a"), F.col("other").alias("b"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for each row of docs; root, a fingerprint, tells components without any id apart."""
    table = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    named = materialise(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    ids = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return table.join(named, table["fp"] == named["f"]).select("doc_id", "h", "fp", "root", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component one, that of the smallest doc_id, and of its texts that of least hash."""
    rows = materialise(classes(docs).select("doc_id", "h", "root"), "classes")
    each = rows.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    sizes = rows.groupBy(F.col("root").alias("c")).agg(F.count("*").alias("size"), F.min(order).alias("first")).where("size > 1")
    fates = each.join(sizes, F.col("root") == F.col("c")).select(F.col("doc_id").alias("__near_id"), F.col("h").alias("__near_text"), "n", order.eqNullSafe(F.col("first")).alias("stays"))
    fates = materialise(fates, "fates")
    gone, again = fates.where("NOT stays OR n > 1").drop("n", "stays"), fates.where("stays AND n > 1").drop("n", "stays")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__near_id")) & (_text_hash() == F.col("__near_text"))
    n_gone, n_again = gone.count(), again.count()
    stay = docs if not n_gone else docs.join(by_checked_size(gone, n_gone), on, "left_anti")
    if n_again:  # rows that repeat id and text: one of each
        one = docs.join(by_checked_size(again, n_again), on, "left_semi").withColumn("__near_text", text_or_empty()).dropDuplicates(["doc_id", "__near_text"])
        stay = stay.unionByName(one.drop("__near_text"))
    return stay


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
