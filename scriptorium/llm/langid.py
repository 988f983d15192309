"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased; what isn't a letter counts as one blank. N-grams of 1 to 3 characters are hashed into BUCKETS
features, weighed by (1 + log tf) * idf and scaled to length 1. Weights are trained by follow-the-regularised-leader
(proximal) with elastic-net penalties, which leaves most of them exactly zero; then one temperature is fitted on rows
kept back, so that scores are probabilities.

Document frequencies are counted over all documents to learn from. The weights learn from a bounded sample of them: at most
SAMPLE_ROWS rows of each language, and at most ALL_ROWS together, shared out evenly; those of least hash. Whole texts
count throughout, a block of characters at a time. Executors turn texts to features; the driver holds those of the
sample, and the model's BUCKETS x languages floats. There is no bound on the number of languages.

Defined results: `und` with score 0 if the text is null or has no letter, or if there was nothing to learn from. With
one language only, that language with score 1. Rows with a null lang are predicted and not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import by_checked_size, ship
from .common import crc_mod

GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE_ROWS = 500
ALL_ROWS = 20_000
#: Features of a part of the frequency table that is summed up on its own.
PART = 1 << 13
#: Sums of each part that are made beside each other before the driver adds them.
SALTS = 16
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Characters turned into n-grams at a time.
BLOCK = 1 << 18
FOLDS = 5


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its own number if it is a letter, else a blank's."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs in the whole text; None without a letter."""
    table, total, some, tail = _letters(), None, False, np.array([32], np.uint64)
    for at in range(0, len(text), BLOCK):
        codes = table[np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
        some = some or bool((codes != 32).any())
        codes = np.concatenate((tail, codes, np.array([32], np.uint64) if at + BLOCK >= len(text) else np.array([], np.uint64)))
        blank = codes == 32
        codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
        found, h = [], np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in GRAMS:
                h = (codes if n == 1 else h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]) + np.uint64(n)
                skip = 0 if at == 0 else max(0, len(tail) - n + 1)  # those within the tail were counted with the block before
                found.append((h[skip:] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS)
        got = np.bincount(np.concatenate(found), minlength=BUCKETS)
        total = got if total is None else total + got
        tail = codes[-(GRAMS[-1] - 1) :]
    return total if some else None


def sparse(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, counts) of the features that occur."""
    at = np.flatnonzero(total).astype(np.int32)
    return at, total[at].astype(np.float32)


def features(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the features that occur, scaled to length 1."""
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages, float32
    bias: np.ndarray
    temperature: float

    def logits(self, total: np.ndarray) -> np.ndarray:
        at, n = sparse(total)
        return features(at, n, self.idf) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        total = counts(text) if text else None
        if total is None or not self.languages:
            return "und", 0.0
        p = _softmax(self.logits(total) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) rows alone."""
    known = [(*sparse(c), lang) for text, lang in rows if (c := counts(text)) is not None]
    seen = np.bincount(np.concatenate([at for at, _, _ in known]), minlength=BUCKETS) if known else np.zeros(BUCKETS)
    return fit_features(known, seen, len(known))


def fit_features(known: list[tuple[np.ndarray, np.ndarray, str]], seen: np.ndarray, documents: int) -> Model:
    """known: features, counts and language of sampled rows; seen: in how many of all documents each feature is. Every FOLDS-th row sets the temperature only."""
    languages = tuple(sorted({lang for *_, lang in known}))
    if not known:
        return Model((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + documents) / (1 + seen)) + 1
    data = [(at, features(at, n, idf).astype(np.float32), languages.index(lang)) for at, n, lang in known]
    learn = [d for i, d in enumerate(data) if i % FOLDS] or data
    k = len(languages)
    z, n, bias = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k)
    # Weights of a feature follow from its sums of gradients: zero within L1, else shrunk by L2 and the learning rate.
    weigh = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    draw = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(learn)):
            at, x, y = learn[i]
            zs, ns = z[at], n[at]
            w = weigh(zs, ns)
            error = _softmax(x @ w + bias)
            error[y] -= 1
            g = x[:, None] * error
            after = ns + g * g
            z[at] = zs + g - (np.sqrt(after) - np.sqrt(ns)) / ALPHA * w
            n[at] = after
            bias -= 0.02 * error
    model = Model(languages, idf, weigh(z, n).astype(np.float32), bias, 1.0)
    back = [d for i, d in enumerate(data) if not i % FOLDS] or data
    logits = np.array([x @ model.weights[at] + bias for at, x, _ in back])
    truth = np.array([y for *_, y in back])
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(truth)), truth])).mean()
    return Model(languages, idf, model.weights, bias, float(min(np.geomspace(0.02, 20, 120), key=loss)))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many have a letter: every task sums up its own, and parts of the table are added."""
    schema = "part int, salt int, seen binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + PART, np.int64)  # the last part holds the number of texts
        for batch in batches:
            for t in batch.column(0):
                total = counts(t.as_py())
                if total is not None:
                    seen[:BUCKETS] += total > 0
                    seen[BUCKETS] += 1
        if seen[BUCKETS]:
            blobs = [seen[i : i + PART].tobytes() for i in range(0, len(seen), PART)]
            salt = [TaskContext.get().partitionId() % SALTS] * len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(salt, pa.int32()), pa.array(blobs, pa.binary())], ["part", "salt", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "seen"])

    parts = texts.select("text").mapInArrow(count, schema).repartition("part", "salt").mapInArrow(add, "part int, seen binary")
    out = np.zeros(BUCKETS + PART, np.int64)
    for r in parts.collect():  # the table, SALTS times at most
        out[r["part"] * PART : (r["part"] + 1) * PART] += np.frombuffer(r["seen"], np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


def sampled(labelled: DataFrame, rows: int, all_rows: int) -> DataFrame:
    """(doc_id, text, lang): of each language the rows of least hash, as many as the bounds allow.

    Languages are counted first. A threshold on the hash then leaves a few more rows than wanted, whatever the language's
    share, and only those are ranked: a language with most of the rows is no heavier than others.
    """
    sizes = labelled.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    languages = sizes.count()
    wanted = max(1, min(rows, all_rows // max(1, languages)))
    some = wanted + 6 * math.isqrt(wanted) + 6
    draw = F.xxhash64("doc_id", "text")
    ids = labelled.join(by_checked_size(sizes, languages), F.col("lang") == F.col("l")).withColumn("draw", draw)
    ids = ids.where(F.shiftrightunsigned("draw", 1) / F.lit(float(1 << 63)) * F.col("n") <= some).select("doc_id", "text", "lang", "draw").distinct()
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted).select("doc_id", "text", "lang")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, all_rows: int = ALL_ROWS) -> Model:
    """Learns from documents with a lang outside the held-out fold (crc32 of doc_id mod 5 is 0), at most so many of them."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0)).select("doc_id", "text", "lang")
    seen, documents = frequencies(labelled)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, ats, ns = [], [], [], []
            for doc, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total = counts(text)
                if total is not None:
                    at, n = sparse(total)
                    ids.append(doc), langs.append(lang), ats.append(at.tobytes()), ns.append(n.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], ["doc_id", "lang", "at", "n"])

    sample = sampled(labelled.withColumn("doc_id", F.col("doc_id").cast("long")), rows, all_rows)
    got = sample.mapInArrow(turn, "doc_id long, lang string, at binary, n binary").toPandas().sort_values(["doc_id", "lang", "at"])
    known = [(np.frombuffer(a, np.int32), np.frombuffer(n, np.float32), lang) for a, n, lang in zip(got["at"], got["n"], got["lang"], strict=True)]
    return fit_features(known, seen, documents)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs, over whole texts."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    got = docs.select("doc_id", run(F.col("text")).alias("p"))
    return got.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "p.lang_pred", "p.score")


def langid_query(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
