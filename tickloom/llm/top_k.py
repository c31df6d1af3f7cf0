"""Operator 1: exact top-k search by inner product, with block-max pruning.

Vectors are blocks of neighbours (ranges in the order of a coarse signature), each with a forward index (its rows)
and its term maxima: for every dimension the largest and smallest value. A query's bound for a block is the sum of
its components times the maxima of fitting sign. Blocks are scored in the order of their bounds, until the next
bound is below the k-th best score; ties are kept, so the result is exact.

Queries meet vectors in tiles: a task holds some thousands of vectors and of queries, and each query's k best of a
tile are ranked over all tiles. Where there are several tiles, one of them is searched first, and its k-th scores are
the thresholds that all others begin with.

How much is skipped depends on the vectors: most of it where they are sparse or clustered; nothing where they are
evenly spread in many dimensions, since every block's maxima then add up to more than any score.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import quoted, stored

#: Vectors and queries of one tile, and vectors of one block.
TILE, TILE_QUERIES, BLOCK = 1 << 14, 1 << 11, 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null, or holds null or a non-finite value."""
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up by zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


class BlockIndex:
    """`seen` and `skipped` count the blocks that searches have scored and left out."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        """Neighbours: rows with the same largest dimensions and signs stand together."""
        size = np.abs(rows.astype(float))
        strong = np.argsort(-size, axis=1, kind="stable")[:, :2] if rows.shape[1] > 1 else np.zeros((len(rows), 2), int)
        sign = np.take_along_axis(rows, strong, 1) < 0 if rows.shape[1] > 1 else np.zeros((len(rows), 2), bool)
        order = np.lexsort((ids, sign[:, 1], strong[:, 1], sign[:, 0], strong[:, 0])) if len(rows) else np.zeros(0, int)
        self.ids, self.rows, self.block = ids[order], rows[order], block
        at = np.arange(0, len(ids), block)
        self.top = _largest(rows)
        self.high, self.low = np.maximum.reduceat(self.rows, at).astype(float), np.minimum.reduceat(self.rows, at).astype(float)
        self.small = self.rows.astype(float)
        self.seen = self.skipped = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries x blocks), never below a score: where doubles round, by what they can be off for these terms."""
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        out = up @ self.high.T + down @ self.low.T
        if self.magnitude(queries) < 1 << 53:
            return out
        terms = np.abs(queries.astype(float)) @ np.maximum(np.abs(self.high), np.abs(self.low)).T
        return out + terms * (queries.shape[1] + 4) * 2.0**-51 + 1

    def magnitude(self, queries: np.ndarray) -> int:
        """No sum of products is larger."""
        return self.top * _largest(queries) * max(1, queries.shape[1])

    def _scores(self, at: np.ndarray, query: np.ndarray, magnitude: int) -> np.ndarray:
        """Exact: by doubles or 64-bit integers where no sum can leave them, else by Python's integers, kept within 64 bits."""
        if magnitude < 1 << 53:
            return (self.small[at] @ query.astype(float)).astype(np.int64)
        if magnitude < 1 << 63:
            return self.rows[at] @ query
        whole = self.rows[at].astype(object) @ query.astype(object)
        return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in whole], np.int64)

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, magnitude: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows with another id; ties to smaller ids. Rows below `least` aren't wanted."""
        order = np.argsort(-bound, kind="stable")
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step = 0, 4
        while done < len(order):
            floor = max(int(best[-1]) if len(best) >= k else -(1 << 63), -(1 << 63) if least is None else least)
            take = order[done : done + step]
            take = take[bound[take] >= floor]
            if not len(take):
                break
            done, step = done + step, step * 2
            self.seen += len(take)
            at = (take[:, None] * self.block + np.arange(self.block)).ravel()
            at = at[at < len(self.ids)]
            score = self._scores(at, query, magnitude)
            own = (self.ids[at] != query_id) & (score >= floor)
            best_id, best = np.append(best_id, self.ids[at][own]), np.append(best, score[own])
            rank = np.lexsort((best_id, ~best))[:k]
            best_id, best = best_id[rank], best[rank]
            self.skipped -= len(take)
        self.skipped += len(order)
        return best_id, best


def _largest(rows: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(int(rows.max(initial=0)), -int(rows.min(initial=0)))


def _tile(k: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            width = max(int(np.diff(np.asarray(t.column("v").combine_chunks().offsets)).max()) for t in (queries, vectors))
            index = BlockIndex(vectors.column("id").to_numpy(), _matrix(vectors.column("v"), width))
            matrix, ids, least = _matrix(queries.column("v"), width), queries.column("id").to_numpy(), queries.column("least").to_pylist()
            bounds, magnitude = index.bounds(matrix), index.magnitude(matrix)
            for i, query, bound, floor in zip(ids, matrix, bounds, least, strict=True):
                found, score = index.search(int(i), query, bound, k, magnitude, floor)
                for o, x in zip(out, (np.full(len(found), i), found, score), strict=True):
                    o.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *o]), pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    return run


def _search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each tile, from (id, v, a, b, least) and (id, v, a, b)."""
    fresh = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # both sides come from one table
    return fresh.groupBy("a", "b").cogroup(vectors.groupBy("a", "b")).applyInArrow(_tile(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by `every`, against all rows.

    Vectors that are null or hold null or a non-finite component, and rows without an id, take no part. Shorter
    vectors count as filled up by zeros. Rows of one id are separate candidates; as queries they are one, with the
    best of both. A query without any candidate has no row. Components and scores beyond 64 bits saturate.
    """
    rows = vectors.select(quoted(key).cast("long").alias("id"), quantised(quoted(vector)).alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    per_id = rows.groupBy("id").agg(F.count("*").alias("c"))
    hot = per_id.where(F.col("c") > TILE)
    n, n_queries, n_hot = per_id.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id") % every == 0, F.col("c"))), F.lit(0)), F.count_if(F.col("c") > TILE)).first()
    if n_hot:  # of equal rows of one id, k are as good as all
        own_rows = rows.join(hot.select("id"), "id", "left_semi").groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("c"))
        own_rows = own_rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("c")))).select("id", "v")
        rows = rows.join(hot.select("id"), "id", "left_anti").unionByName(own_rows)
    n_tiles, n_query_tiles = max(1, math.ceil(n / TILE)), max(1, math.ceil(n_queries / TILE_QUERIES))
    # Each query goes to every column of tiles, each vector to every row of them; ids are spread by hash, equal ones
    # by their values as well.
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    own = rows.where(F.col("id") % every == 0).withColumn("a", place(n_query_tiles))
    all_rows = rows.withColumn("b", place(n_tiles)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_query_tiles - 1)))).select("id", "v", "a", "b")
    none = F.lit(None).cast("long").alias("least")
    if n_tiles == 1:
        found = _search(own.select("id", "v", "a", F.lit(0).alias("b"), none), all_rows, k)
    else:
        first = stored(_search(own.select("id", "v", "a", F.lit(0).alias("b"), none), all_rows.where("b = 0"), k))
        floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        asked = own.join(floors, "id", "left").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_tiles - 1))))
        found = first.unionByName(_search(asked.select("id", "v", "a", "b", "least"), all_rows.where("b > 0"), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
