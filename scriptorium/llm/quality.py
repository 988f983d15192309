"""Quality classifier: zstandard dictionaries of good and of bad text, their compressed-size difference as a calibrated score.

A text is compressed twice, in blocks, with a dictionary trained on good and with one trained on bad labelled text. The
difference of the two sizes, normalised by the text's length and by the smaller size, says which corpus it is nearer
to. A logistic curve fitted on labelled rows that neither dictionary saw turns this into a probability.

Whole texts count throughout. A dictionary learns from blocks drawn from all of its sampled texts; the curve is fitted on
sizes of whole texts, which executors compute by the scorer itself. The driver holds SAMPLE_BLOCKS blocks of each class and
four numbers for a row. Only the model, at most 2 x DICT_BYTES plus a few numbers, travels to the executors.

Defined results: null and empty texts are scored as the empty text (its features are 0). With no labelled rows, or
rows of one class only, the score is that class's share, or 0.5 without any. Repeated rows get equal scores. Labels
that disagree for one document are all used. Extra columns are ignored by score() and kept by accept().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import by_checked_size, materialise, ship
from .common import crc_mod, text_or_empty

#: Labelled rows of each class that train a dictionary, and as many again that fit the curve, at most.
SAMPLE_ROWS = 1500
#: Blocks of sampled texts, of BLOCK bytes at most, that train a dictionary: those of least hash, from anywhere in the whole texts.
SAMPLE_BLOCKS = 12_000
DICT_BYTES = 262_144
LEVEL = 3
#: Bytes compressed at a time.
BLOCK = 2048
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        if not self.good or not self.bad:
            constant = self.weights[0]
            return lambda data: constant
        sizes = _sizer(self.good, self.bad)
        w = np.asarray(self.weights)
        return lambda data: float(1 / (1 + math.exp(-max(-60.0, min(60.0, float(w @ _features(*sizes(data), len(data))))))))


def _sizer(good: bytes, bad: bytes):
    """Compressed sizes of bytes by either dictionary, block by block: a long text must not become its own dictionary."""
    packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False) for d in (good, bad)]
    return lambda data: tuple(sum(len(p.compress(data[at : at + BLOCK])) for at in range(0, len(data), BLOCK)) for p in packers)


def _features(good: int, bad: int, n: int) -> np.ndarray:
    if not n:
        return np.array([1.0, 0.0, 0.0, 0.0])
    by_length = 100 * (bad - good) / n
    by_size = (bad - good) / max(1, min(good, bad))
    return np.array([1.0, by_length, 10 * by_size, max(-2.0, min(2.0, by_length))])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; each class weighs by its rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes in blocks of whole lines; a line longer than a block is cut."""
    held = b""
    for line in data.split(b"\n"):
        if held and len(held) + len(line) >= size:
            yield held
            held = b""
        held = held + b"\n" + line if held else line
        while len(held) > size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def chosen(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y, half), as a table: the labelled rows to learn from, outside the held-out fold (crc32 of doc_id mod 4 is 2).

    Of each class, the 2 x rows ids of least hash are drawn on the narrow label table; `half` halves them by hash.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    known = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows) for q in (1, 0)]
    known = known[0].unionByName(known[1]).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    got = texts.join(by_checked_size(known, 4 * rows), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y").distinct()
    return materialise(got.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0), "labelled")


def _dictionaries(sample: DataFrame, n: int) -> list[bytes]:
    """Of good and of bad samples: n blocks of each at most. Lines that several texts hold are boilerplate, not a sign of either, and are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts = list(blocks(text.encode()))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.int64()), pa.array(parts, pa.binary()), pa.array([y] * len(parts), pa.int32())], ["doc_id", "block", "y"])

    every = sample.select("doc_id", "text", "y").mapInArrow(cut, "doc_id long, block binary, y int").distinct()
    every = every.withColumn("draw", F.xxhash64("doc_id", "block"))
    drawn = [every.where(F.col("y") == q).orderBy("draw").limit(n).collect() for q in (1, 0)]  # n x BLOCK bytes
    holders: dict[bytes, int] = {}
    shared = set()
    for r in (r for rs in drawn for r in rs):
        shared |= {line for line in bytes(r["block"]).split(b"\n") if holders.setdefault(line, r["doc_id"]) != r["doc_id"]}
    own = lambda data: b"\n".join(line for line in data.split(b"\n") if line not in shared)
    return [_dictionary([d for r in rs if (d := own(bytes(r["block"])))]) for rs in drawn]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, sample_blocks: int = SAMPLE_BLOCKS) -> Model:
    """Learns from labelled rows outside the held-out fold; the bounds are those of chosen() and SAMPLE_BLOCKS."""
    spark = docs.sparkSession
    ship(spark)
    sample = chosen(docs, labels, rows)
    y = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(y) < 2:
        return Model(b"", b"", (float(next(iter(y))) if y else 0.5,))
    halves = {(r["half"], r["y"]) for r in sample.select("half", "y").distinct().collect()}
    both = lambda h: {(h, 0), (h, 1)} <= halves
    dicts = _dictionaries(sample.where("half") if both(True) else sample, sample_blocks)
    rest = sample.where("NOT half") if both(False) else sample
    shared = spark.sparkContext.broadcast(tuple(dicts))

    @F.pandas_udf("array<long>")
    def sized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _sizer(*shared.value)
        for texts in batches:
            yield pd.Series([[*sizes(d), len(d)] for d in map(str.encode, texts)])

    got = rest.select("doc_id", "y", sized("text").alias("s")).collect()  # four numbers a row
    got = sorted((r["doc_id"], *r["s"], r["y"]) for r in got)
    return Model(*dicts, tuple(_fit(np.array([_features(*g[1:4]) for g in got]), np.array([g[4] for g in got], float))))


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve as the dictionary
        return b"\n".join(samples)[-DICT_BYTES:] or b"\n"


def _scored(docs: DataFrame, model: Model):
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value.scorer()
        for texts in batches:
            yield pd.Series([f(t.encode()) for t in texts], dtype="float64")

    return scored(text_or_empty())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs, over whole texts."""
    return docs.select("doc_id", _scored(docs, model).alias("score"))


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns. Only texts visit Python."""
    return docs.withColumn("__quality_score", _scored(docs, model)).where(F.col("__quality_score") >= threshold).drop("__quality_score")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    scores = score(docs, train(docs, labels))
    return scores.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
