"""Approximate nearest neighbours by collision-counting hashing.

The largest inner product is the least distance once every vector has one more component that brings all to one length.
Each of DIRECTIONS unit directions, orthonormal bases one after another, is a hash function of one projection, kept as a
sorted array by block of rows. A query uses the FARTHEST directions on which it lies farthest from the origin: there its
neighbours lie apart from most rows. Its window in each of their arrays is centred on its own projection and widens
level by level (virtual rehashing: nothing is hashed again); a row collides once for each level's window that it is in.
Rows whose collisions exceed the block's threshold are verified: the threshold is the highest that lets VERIFY of the
block and SPARE times k rows pass, ties included. Every row is in the index, and every query meets every block, so no
row is out of reach.

Blocks of rows are large, so that each row is shuffled once for QUERIES queries and each query once for ROWS rows. The
widths are quantiles of projected distances over at most SAMPLE rows, those with the least hash of their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.llm.common import table

SAMPLE, DIRECTIONS, FARTHEST = 2000, 256, 28
LEVELS = (0.1, 0.3)
VERIFY, SPARE = 0.08, 4
ROWS, QUERIES = 16_384, 16_384
SEED = 5


def directions(d: int) -> np.ndarray:
    """(d, about DIRECTIONS): whole orthonormal bases of d dimensions, side by side."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(max(1, -(-DIRECTIONS // d)))], 1)


def farthest(projected: np.ndarray) -> np.ndarray:
    """For each query the FARTHEST directions with the largest projections, either way."""
    m = min(FARTHEST, projected.shape[1])
    return np.argsort(-np.abs(projected), 1, kind="stable")[:, :m]


class Index:
    """Sorted projections of a block of vectors. basis: (dimension + 1, directions); widths: half the window by level."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray, widths: np.ndarray, longest: float):
        self.vectors, self.basis, self.widths = vectors, basis, widths
        more = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        projected = (np.column_stack([vectors, more]) @ basis).T.copy()
        self.order = np.argsort(projected, 1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, 1)

    def collisions(self, queries: np.ndarray):
        """For each projected query, the collisions of every row over all levels."""
        used, (m, n) = farthest(queries), self.order.shape
        lo = np.empty((len(self.widths), m, len(queries)), np.int64)
        hi = np.empty_like(lo)
        for j in range(m):
            for r, w in enumerate(self.widths):
                lo[r, j] = np.searchsorted(self.sorted[j], queries[:, j] - w, "left")
                hi[r, j] = np.searchsorted(self.sorted[j], queries[:, j] + w, "right")
        for k in range(len(queries)):
            total = np.zeros(n, np.int16)
            for j in used[k]:  # a direction's array holds each row once, so plain indexing adds
                order = self.order[j]
                for r in range(len(self.widths)):
                    total[order[lo[r, j, k] : hi[r, j, k]]] += 1
            yield total

    def search(self, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query id, ids, scores, rows verified) for each query: the k best of the verified rows, by score, then id."""
        scale = np.sqrt((self.vectors**2).sum(1).max()) / np.sqrt((queries**2).sum(1))
        projected = np.column_stack([queries * scale[:, None], np.zeros(len(queries))]) @ self.basis
        want = min(len(ids), SPARE * k + 1 + int(VERIFY * len(ids)))
        for q, vector, total in zip(query_ids, queries, self.collisions(projected), strict=True):
            threshold = np.partition(total, len(total) - want)[len(total) - want]
            at = np.nonzero((total >= threshold) & (ids != q))[0]
            score = (self.vectors[at] * vector).sum(1)  # the same sum for equal vectors wherever they lie
            best = np.lexsort((ids[at], -score))[:k]
            yield q, ids[at][best], score[best], len(at)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): vectors as arrays of doubles that are neither null nor zero, of finite components only."""
    x = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda c: c != 0))


def fitted(sample: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(basis, widths) from a sample of rows: the widths within which LEVELS of them lie from a query, on its directions."""
    basis = directions(sample.shape[1] + 1)
    more = np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0))
    rows = np.column_stack([sample, more]) @ basis
    scale = longest / np.sqrt((sample[:64] ** 2).sum(1))
    asked = np.column_stack([sample[:64] * scale[:, None], np.zeros(len(sample[:64]))]) @ basis
    used = farthest(asked)
    away = [np.abs(rows[:, js] - q[js]).ravel() for q, js in zip(asked, used, strict=True)]
    return basis, np.quantile(np.concatenate(away), LEVELS)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query (over id) holds, its k nearest found.

    Null, zero and non-finite vectors, and those of another dimension than most rows, take no part; neither does a null
    id. A row is no neighbour of its own id. Repeated rows: a query counts once an id, by the least of its vectors in
    order of components, and a neighbour once a row. Ties: the smaller id first. Extra columns are ignored. Empty
    table, or no query: empty.
    """
    x = usable(vectors, id_column, vector_column)
    sizes = x.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).alias("longest")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    x = x.where(F.size("v") == sizes.d)
    sample = np.array([r.v for r in x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    longest = float(sizes.longest)
    basis, widths = fitted(sample, longest)

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            index = Index(np.stack(rows.v.to_numpy()).astype(np.float64), basis, widths, longest)
            for at in range(0, len(queries), 512):
                part = queries.iloc[at : at + 512]
                for q, ids, scores, _ in index.search(rows.id.to_numpy(), part.id.to_numpy(), np.stack(part.v.to_numpy()).astype(np.float64), k):
                    out.append((q, [{"vec_id": int(i), "score": float(s)} for i, s in zip(ids, scores, strict=True)]))
        return pd.DataFrame(out, columns=["query_id", "found"])

    narrow = dict(vectors.dtypes)[vector_column] == "array<float>"
    x = x.withColumn("v", F.col("v").cast("array<float>")) if narrow else x  # exact, and half as much to move
    asking = x.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    row_blocks, query_blocks = max(1, -(-sizes.n // ROWS)), max(1, -(-asking.count() // QUERIES))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.select("id", "v", block(row_blocks, 1).alias("rb"), every(query_blocks).alias("qb")).groupBy("rb", "qb")
    right = asking.select("id", "v", block(query_blocks, 2).alias("qb"), every(row_blocks).alias("rb")).groupBy("rb", "qb")
    found = left.cogroup(right).applyInPandas(search, "query_id long, found array<struct<vec_id:long,score:double>>")
    found = found.select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # limited by each task before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector, as the query's contract has it."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
