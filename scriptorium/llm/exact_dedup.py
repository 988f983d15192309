"""Exact dedup by two passes: a counting Bloom filter names the possibly repeated hashes, and only their rows shuffle.

Pass 1 counts, for each cell of the filter, whether no key, one or more than one fell into it. Tasks send the cells of
their rows in blobs, a segment of the filter at a time and each cell twice at most, so that a text copied any number of
times costs a task no more than one copied twice. Each segment is summed on its own and comes back as one bit for each
cell: "hit at least twice". Pass 2 tests each row's key against these bits. A row with a cell hit only once has no equal
anywhere and passes straight through; the rest, repeats and a few false positives, are grouped exactly.

The filter has BITS_PER_KEY cells for a row. It is made in slices of SLICE_BITS (32 MB of bits, the bound of what is
broadcast): keys are dealt to slices by hash, digests are written to a folder for each slice, and both passes run slice by
slice, each reading its own folder only. So single rows pass through at any size alike.

Defined results: null texts count as empty ones. Of equal texts, the row with the largest doc_id stays (a null id is
less than any). Rows that repeat both id and text are one more copy each; one of them stays. Empty tables give empty
results. Extra columns are ignored by decisions() and kept by survivors(); where rows repeat id and text, whose extra
columns stay is not defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import by_checked_size, materialise, new_path, ship
from .common import copies, text_or_empty

BITS_PER_KEY = 16
HASHES = 3
MIN_BITS = 1 << 16
SLICE_BITS = 1 << 28
#: Cells' hits that one task sums at most, on average.
HITS_PER_SEGMENT = 1 << 22
#: Rows that a task of pass 1 gathers before it sends their cells.
FLUSH_ROWS = 1 << 20


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES rows of cell numbers, by multiplication with odd constants and a xor shift."""
    k = keys.astype(np.int64, copy=False).view(np.uint64)
    out = np.empty((HASHES, len(k)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            x = (k + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            out[j] = (x * np.uint64(0x94D049BB133111EB) >> np.uint64(20)) & np.uint64(bits - 1)
    return out


def filter_bits(rows: int) -> int:
    """Cells of the filter of one slice that holds so many rows."""
    return min(SLICE_BITS, max(MIN_BITS, 1 << max(1, rows * BITS_PER_KEY - 1).bit_length()))


def slices(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_KEY // SLICE_BITS))


def repeated_cells(keys: DataFrame, rows: int) -> np.ndarray:
    """Pass 1. keys: one long column. Packed bits, one for each cell, set where two or more rows fell in."""
    ship(keys.sparkSession)
    bits = filter_bits(rows)
    segments = min(bits // 8, 1 << (max(64, rows * HASHES // HITS_PER_SEGMENT) - 1).bit_length())
    width = bits // segments

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if parts:
                all_cells, often = np.unique(np.concatenate([cells(p, bits).ravel() for p in parts]), return_counts=True)
                all_cells = np.repeat(all_cells, np.minimum(often, 2))
                edges = np.searchsorted(all_cells, np.arange(segments + 1, dtype=np.uint64) * np.uint64(width))
                full = np.flatnonzero(np.diff(edges))
                blobs = [(all_cells[edges[s] : edges[s + 1]] - np.uint64(s * width)).astype(np.uint32).tobytes() for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["segment", "hits"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield from send(held)
                held = []
        yield from send(held)

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(width, np.uint8)
        for blob in group["hits"]:
            own = np.bincount(np.frombuffer(blob, np.uint32), minlength=width)
            count = np.minimum(2, count + np.minimum(2, own)).astype(np.uint8)
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "bits": [np.packbits(count >= 2, bitorder="little").tobytes()]})

    summed = keys.mapInArrow(hits, "segment int, hits binary").groupBy("segment").applyInPandas(add_up, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in summed.collect():  # bits / 8 bytes at most
        out[r["segment"] * width // 8 : (r["segment"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe_repeated(shared, key: str):
    """Pass 2: a boolean column, false only where no other row of pass 1 has this key. shared: the broadcast bits of pass 1."""

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for keys in batches:
            at = cells(keys.to_numpy(), len(table) * 8)
            yield pd.Series(((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0))

    return test(F.col(key))


def _digest(text: str = "text"):
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def tested(docs: DataFrame) -> DataFrame:
    """doc_id, digest, maybe, as a table: one row for each row of docs, whose texts are read once; `maybe` is false only for texts that occur once."""
    spark = docs.sparkSession
    n = slices(docs.count())
    key = F.xxhash64("digest")
    path, out = new_path(spark, "digests"), new_path(spark, "tested")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")).withColumn("slice", F.pmod(F.xxhash64("digest", F.lit("slice")), F.lit(n)).cast("int"))
    table.write.partitionBy("slice").parquet(path)
    table = spark.read.schema("doc_id long, digest binary, slice int").parquet(path)
    for k in range(n):
        mine = table.where(F.col("slice") == k).select("doc_id", "digest", key.alias("key"))
        shared = spark.sparkContext.broadcast(repeated_cells(mine.select("key"), mine.count()))  # SLICE_BITS / 8 bytes at most
        mine.select("doc_id", "digest", maybe_repeated(shared, "key").alias("maybe")).write.mode("append").parquet(out)
        shared.destroy()
    return spark.read.schema("doc_id long, digest binary, maybe boolean").parquet(out)


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest (32 bytes): one row for each row of docs."""
    ship(docs.sparkSession)
    tests = tested(docs)
    alone = tests.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")

    shared = materialise(tests.where("maybe").groupBy("digest", "doc_id").agg(F.count("*").alias("same")), "candidates")
    groups = materialise(shared.groupBy(F.col("digest").alias("d")).agg(F.max("doc_id").alias("keep_id"), F.sum("same").alias("group_size")), "groups")
    placed = shared.join(groups, shared["digest"] == groups["d"])  # a hot digest is split by the engine's skew join
    placed = copies(placed.select("doc_id", "keep_id", "group_size", "digest", "same"), "same", "copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return alone.unionByName(placed.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    verdicts = materialise(decisions(docs).where("group_size > 1"), "verdicts").select("doc_id", "digest", "kept")
    each = verdicts.groupBy(F.col("doc_id").alias("__dedup_id"), F.col("digest").alias("__dedup_digest")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    each = materialise(each, "fates")
    gone = each.where("not kept or n > 1").drop("kept", "n")
    again = each.where("kept and n > 1").drop("kept", "n")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__dedup_id")) & (_digest() == F.col("__dedup_digest"))
    n_gone, n_again = gone.count(), again.count()
    stay = docs if not n_gone else docs.join(by_checked_size(gone, n_gone), on, "left_anti")
    if n_again:  # rows that repeat id and text: one of each
        stay = stay.unionByName(docs.join(by_checked_size(again, n_again), on, "left_semi").withColumn("__dedup_text", text_or_empty()).dropDuplicates(["doc_id", "__dedup_text"]).drop("__dedup_text"))
    return stay


def exact_dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs, dropped ones too."""
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
