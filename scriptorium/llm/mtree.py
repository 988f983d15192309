"""Exact top-k by inner product, with M-trees searched best-first.

Inner products become distances: with one more coordinate, sqrt(R^2 - |x|^2) for a row and 0 for a query, where R is
the longest row's length, |q - x|^2 = |q|^2 + R^2 - 2 <q, x>. So the nearest row has the highest product, ties included.

Every row is indexed. Rows are dealt by hash into blocks of about BLOCK_ROWS; a task builds one block's M-tree, whose
pages hold routing objects with their covering radius, the distance of each entry to the page's own routing object
and the pages below. A search takes pages from a heap by their least possible distance and ends when that exceeds the
k-th best. Within a page, the stored distance to the parent and the triangle inequality rule out entries before any
distance is computed. Rows' products are computed exactly. A query's best k of all blocks are then ranked.

Queries meet blocks in groups of at most QUERY_GROUP, so a task holds one tree and one group.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
vec_id. Only vectors of the same length are compared. A query's own row is every row of its vec_id. Rows that repeat a
vec_id each count as candidates. Products beyond a long are cut to its range.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise, ship

TOP = 5
QUERY_STEP = 50
SCALE = 256
BLOCK_ROWS = 1 << 14
QUERY_GROUP = 1 << 13
LEAF, FAN = 384, 16
#: Products below this are exact in doubles.
EXACT = float(1 << 53)


class MTree:
    """Pages over integer vectors, given as doubles where products stay below 2^53 and as Python ints beyond."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach2: float):
        self.reach2 = reach2
        self.pages: list[dict] = []
        plain = vectors.astype(np.float64)
        lift = np.sqrt(np.maximum(0.0, reach2 - (plain * plain).sum(axis=1)))
        self._ids, self._exact, self._at = ids, vectors, np.hstack((plain, lift[:, None]))
        self._build(np.arange(len(ids)), None)
        del self._ids, self._exact, self._at

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = self._at[rows] - to
        return np.sqrt((d * d).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        me = len(self.pages)
        self.pages.append({})
        if len(rows) <= LEAF:
            self.pages[me] = {"ids": self._ids[rows], "rows": self._exact[rows], "to_parent": self._distances(rows, parent) if parent is not None else np.zeros(len(rows))}
            return me
        fan = min(FAN, -(-len(rows) // LEAF))
        seeds = np.sort(np.random.default_rng(len(rows)).choice(len(rows), fan, replace=False))
        near = np.argmin(np.stack([self._distances(rows, self._at[rows[s]]) for s in seeds]), axis=0)
        parts = [(rows[seeds[k]], rows[near == k]) for k in range(fan) if (near == k).any()]
        if max(len(p) for _, p in parts) > 0.9 * len(rows):  # rows that lie (almost) on one point: equal shares
            parts = [(p[0], p) for p in np.array_split(rows, fan)]
        objects = np.stack([self._at[o] for o, _ in parts])
        page = {
            "objects": objects,
            "radius": np.array([self._distances(p, self._at[o]).max() for o, p in parts]),
            "to_parent": np.sqrt(((objects - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(len(parts)),
            "below": [self._build(p, self._at[o]) for o, p in parts],
        }
        self.pages[me] = page
        return me

    def search(self, query: np.ndarray, k: int, own: int | None = None, stats: dict | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k highest products, ties to the smaller id; rows with id `own` left out."""
        plain = np.append(query.astype(np.float64), 0.0)
        length2 = float(plain @ plain)
        slack = 1e-6 * (1 + length2**0.5 + self.reach2**0.5)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
        limit = float("inf")
        heap: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
        while heap:
            least, at, to_parent = heapq.heappop(heap)
            if least > limit:
                break
            page = self.pages[at]
            radius = page.get("radius", 0.0)
            keep = np.flatnonzero(np.abs(page["to_parent"] - to_parent) - radius <= limit) if to_parent is not None else np.arange(len(page["to_parent"]))
            if stats is not None:
                stats["computed"] = stats.get("computed", 0) + len(keep)
                stats["avoided"] = stats.get("avoided", 0) + len(page["to_parent"]) - len(keep)
            if not len(keep):
                continue
            if "below" in page:
                d = page["objects"][keep] - plain
                d = np.sqrt((d * d).sum(axis=1))
                bound = d - page["radius"][keep] - slack
                for i, here, b in zip(keep, d, bound, strict=True):
                    if b <= limit:
                        heapq.heappush(heap, (max(least, float(b)), page["below"][i], float(here)))
                continue
            scores, ids = page["rows"][keep] @ query, page["ids"][keep]
            if len(best) == k:
                worth = scores >= best[0][0]
                scores, ids = scores[worth], ids[worth]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if i != own:
                    entry = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                limit = max(0.0, length2 + self.reach2 - 2 * float(best[0][0])) ** 0.5 + slack
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): floor(256 * x) of every vector that takes part."""
    ok = "embedding IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x AS double)) < double('Infinity'))"
    return vectors.where(ok).selectExpr("cast(vec_id AS long) AS vec_id", f"transform(embedding, x -> floor(cast(x AS double) * {SCALE})) AS v", "size(embedding) AS dim")


def _matrix(column: pa.ChunkedArray, dim: int, exact: bool) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return flat.astype(np.float64) if exact else flat.astype(object)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def top_k(vectors: DataFrame, k: int = TOP, query_step: int = QUERY_STEP, block_rows: int = BLOCK_ROWS, query_group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by query_step, the k best of all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    table = materialise(quantised(vectors), "vectors")
    square = "aggregate(v, 0D, (a, x) -> a + cast(x AS double) * x)"
    facts = table.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.expr(square)).alias("reach2"), F.sum((F.col("vec_id") % query_step == 0).cast("long")).alias("asked"))
    facts = facts.select(F.col("dim").alias("d"), "reach2", F.ceil(F.col("n") / block_rows).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asked") / query_group)).alias("groups"))
    facts = materialise(facts, "facts")  # a row for each length of vector
    rows = table.join(facts, F.col("dim") == F.col("d")).drop("d")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")))

    def index(group: pa.Table) -> pa.Table:
        dim, reach2 = group.column("dim")[0].as_py(), group.column("reach2")[0].as_py()
        order = np.argsort(_column(group, "vec_id"), kind="stable")
        tree = MTree(_column(group, "vec_id")[order], _matrix(group.column("v"), dim, reach2 < EXACT)[order], reach2)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int64()), "groups": pa.array([group.column("groups")[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    trees = materialise(rows.groupBy("dim", "block").applyInArrow(index, "dim int, block long, groups long, tree binary"), "mtrees")

    def search(trees: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(trees) and len(asked):
            tree = pickle.loads(trees.column("tree")[0].as_py())  # written by index()
            dim = asked.column("dim")[0].as_py()
            for q, v in zip(_column(asked, "query_id").tolist(), _matrix(asked.column("v"), dim, asked.column("reach2")[0].as_py() < EXACT), strict=True):
                found += [(q, i, max(-(1 << 63), min((1 << 63) - 1, s))) for s, i in tree.search(v, k, q)]
        return pa.table({c: pa.array([x[j] for x in found], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

    asked = rows.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id", "dim", "v"]).select(F.col("vec_id").alias("query_id"), "v", "dim", "reach2", "blocks", F.pmod(F.xxhash64("vec_id", F.lit("group")), F.col("groups")).alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    keys = ["dim", "block", "part"]
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""


def topk_query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)
