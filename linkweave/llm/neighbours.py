"""Approximate nearest neighbours by collision counting: one projection per hash table, kept as a sorted array.

A table projects every vector on one random direction and sorts the values. A query looks at the window around its own
projection; virtual rehashing widens all windows together by a factor, without new tables. A vector that lies in at
least ``SHARE`` of the windows is verified: its distance is computed from the original vectors. The search stops when the
``k``-th best verified distance is within the radius that the windows stand for, or all vectors are verified. A vector
within the radius is missed only if it falls outside of far more windows than expected: measured recall is in the tests.

Vectors are dealt into blocks by a hash of vec_id, queries into blocks too; a task searches one block of vectors for one
block of queries, and the best of all blocks are merged for each query. Both kinds of blocks have a bounded size, as large as
a task's memory allows with room to spare: a vector is sent once for QUERIES_PER_BLOCK queries, a query once for
VECTORS_PER_BLOCK vectors. Blocks can't be left out: the window of one projection that holds a query's neighbours holds a
good part of all vectors (distances grow with the root of the dimensions, projections don't), so counting touches that part
of every table wherever the rows lie.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of other lengths than the
query's aren't its neighbours. Of repeated vec_ids the least vector takes part. Ties go to the smaller vec_id. Long vectors are
taken whole. Other columns are ignored. An empty table, or one without a query, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import materialise, ship

TABLES, SHARE, WIDTH, GROWTH = 32, 0.65, 2.72, 1.2
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 16384, 8192
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding (array<double>), dims`` of the vectors that take part, one for each vec_id."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dims", F.size("embedding"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class SortedTables:
    """The sorted arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        directions = np.random.default_rng(17).normal(size=(vectors.shape[1], TABLES))
        self.directions = directions
        values = self.vectors @ directions
        self.order = np.argsort(values, axis=0).T.copy()
        self.values = np.sort(values, axis=0).T.copy()

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``k`` nearest found: (ids, distances), nearest first."""
        n = len(self.ids)
        own = np.searchsorted(self.ids, query_id)
        is_own = own < n and self.ids[own] == query_id
        k = min(k, n - is_own)
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        centre = query @ self.directions
        hits = np.zeros(n, np.int32)
        distance = np.full(n, np.inf)
        verified = np.zeros(n, bool)
        if is_own:
            verified[own] = True
        at = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre, strict=True)])
        low, high = at.copy(), at.copy()
        radius = self.first_radius(query, at)
        need = int(np.ceil(SHARE * TABLES))
        while True:
            reach = WIDTH * radius / 2
            to_low = [int(np.searchsorted(v[:b], c - reach)) for v, c, b in zip(self.values, centre, low, strict=True)]
            to_high = [int(np.searchsorted(v[b:], c + reach, side="right")) + b for v, c, b in zip(self.values, centre, high, strict=True)]
            new = [o[a:b] for o, a, b in zip(self.order, to_low, low, strict=True) if a < b] + [o[a:b] for o, a, b in zip(self.order, high, to_high, strict=True) if a < b]
            low, high = to_low, to_high
            if new:
                hits += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
                rows = np.flatnonzero((hits >= need) & ~verified)
                distance[rows] = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
                verified[rows] = True
            if verified.all() or np.partition(distance, k - 1)[k - 1] <= radius:
                break
            radius *= GROWTH
        best = np.argpartition(distance, k - 1)[:k] if k < n else np.arange(n)
        best = np.flatnonzero(distance <= distance[best].max())
        best = best[np.lexsort((self.ids[best], distance[best]))][:k]
        return self.ids[best], distance[best]

    def first_radius(self, query: np.ndarray, at: np.ndarray) -> float:
        """Half the distance to the nearest of the vectors next to the query in the tables; never zero."""
        near = np.unique(self.order[np.arange(TABLES), np.clip(at, 0, len(self.ids) - 1)])
        gap = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
        positive = gap[gap > 0]
        return float(positive.min()) / 2 if len(positive) else 1e-9


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of ``vectors`` for each of ``queries`` but itself.

    Both have ``vec_id, embedding, dims`` (``usable``).
    """
    ship(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // VECTORS_PER_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("query_block", every(query_blocks))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("block", every(blocks))
    keys = ["dims", "block", "query_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tables = SortedTables(left.column("vec_id").to_numpy(), matrix(left.column("embedding")))
            for query_id, query in zip(right.column("vec_id").to_pylist(), matrix(right.column("embedding")), strict=True):
                found.append((query_id, *tables.search(query_id, query, k)))
        ids = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
        query_ids = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]) if found else ids
        return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, RESULT)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = materialise(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
