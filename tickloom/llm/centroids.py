"""Operator 11: k-means over integer vectors, exact in every round.

A vector's components are the integers floor(scale * x). Distances are expanded as |x|^2 - 2 x.c + |c|^2, so that a block
of vectors meets all centroids in one float64 matrix product. That is exact while every term and sum is an integer
below 2^53, which a bound tells for each vector: dims * (largest component + largest of a centroid)^2. Vectors beyond it
are compared by 64-bit integers, and those beyond these by Python's.

Plan. The kept vectors are written once as blocks of doubles. A round is one treeAggregate over the blocks: each task
adds up its clusters' integer sums and counts, the tree combines them, and k * dims integers come to the driver, which
divides them. Nothing is shuffled but these sums; the last pass labels the rows of the source where they lie.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import payload, quoted, release, stored, tables

K, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024
#: Vectors of a block; integers that a double and a long hold with room for the bound's own rounding.
BLOCK, DOUBLE, LONG = 4096, 2.0**52, 2.0**61
MOST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Clusters:
    """Centroids as lists of integers, and the distance summed over each cluster."""

    centroids: list[list[int]]
    inertia: list[int]
    scale: int = SCALE

    def digest(self, j: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[j])).encode()).hexdigest()


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), also where the product is no double. `scale` is a power of two."""
    return int(x) * scale if abs(x) >= DOUBLE else math.floor(x * scale)


def assign(rows: np.ndarray, centroids: list[list[int]], scale: int = SCALE) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(nearest centroid, squared distance) of each row of doubles; ties go to the smaller number."""
    n, dims = rows.shape
    with np.errstate(over="ignore"):
        v = np.floor(rows * scale)
        large = np.abs(v).max(axis=1, initial=0.0)
        top = min(max((abs(c) for row in centroids for c in row), default=0), 1 << 200)
        bound = dims * (large + float(top)) ** 2
    near, far = np.zeros(n, np.int64), np.zeros(n, object)
    easy = bound < DOUBLE
    if easy.all():
        return _by_product(v, centroids)
    if easy.any():
        near[easy], far[easy] = _by_product(v[easy], centroids)
    middle = ~easy & (bound < LONG)
    if middle.any():
        x = v[middle].astype(np.int64)
        d = np.stack([((x - np.array(c, np.int64)) ** 2).sum(axis=1) for c in centroids], axis=1)
        near[middle] = d.argmin(axis=1)
        far[middle] = d.min(axis=1)
    for i in np.flatnonzero(~easy & ~middle):
        x = [whole(float(a), scale) for a in rows[i]]
        far[i], near[i] = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    return near, far.tolist()


def _by_product(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    c = np.array(centroids, float)
    d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(v)), near].astype(np.int64)


def _sums(rows: np.ndarray, near: np.ndarray, k: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer sums and counts of each cluster's rows."""
    sums, counts = np.zeros((k, rows.shape[1]), object), np.bincount(near, minlength=k).astype(object)
    with np.errstate(over="ignore"):
        v = np.floor(rows * scale)
        small = np.abs(v).max(axis=1, initial=0.0) * max(len(rows), 1) < LONG
    for j in range(k):
        sums[j] += v[small & (near == j)].astype(np.int64).sum(axis=0)
    for i in np.flatnonzero(~small):
        sums[near[i]] += np.array([whole(float(a), scale) for a in rows[i]], object)
    return sums, counts


def _kept(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(0), dims)
            parts = [rows[i : i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["block"])

    return run


def k_means(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> Clusters:
    """Centroids after `rounds` rounds, and the inertia of the assignment to them.

    Vectors that are null, hold null or a non-finite component, or haven't `dims` components take no part. The k that
    begin are those with the least sha256 of `<seed>:<id>` (a null id is empty text; of repeated ids the lesser vector
    first); fewer vectors make fewer centroids, none make none. Repeated rows count each. Empty clusters stay where they are.
    """
    spark, own = vectors.sparkSession, quoted(vector).cast("array<double>")
    rows = vectors.select(own.alias("v"), F.coalesce(quoted(key).cast("string"), F.lit("")).alias("id")).where(_kept(F.col("v"), dims))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256)
    centroids = [[whole(x, scale) for x in r.v] for r in rows.orderBy(order, "v").select("v").limit(k).collect()]
    if not centroids:
        return Clusters([], [], scale)
    before = {*tables()}
    blocks = stored(rows.select("v").mapInArrow(_blocks(dims), "block binary"))
    parts = blocks.rdd.map(lambda r: np.frombuffer(bytes(r.block), float).reshape(-1, dims))
    n = len(centroids)

    def add(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    zero = (np.zeros((n, dims), object), np.zeros(n, object))
    for _ in range(rounds):
        now = centroids
        sums, counts = parts.treeAggregate(zero, lambda total, x, now=now: add(total, _sums(x, assign(x, now, scale)[0], n, scale)), add)
        centroids = [[s // int(m) for s in row] if m else old for row, m, old in zip(sums.tolist(), counts, now, strict=True)]
        if centroids == now:  # all further rounds would give the same
            break
    inertia = parts.treeAggregate(np.zeros(n, object), lambda total, x: total + _inertia(x, centroids, scale), lambda a, b: a + b)
    release(spark, [t for t in tables() if t not in before])
    return Clusters(centroids, [int(x) for x in inertia], scale)


def _inertia(rows: np.ndarray, centroids: list[list[int]], scale: int) -> np.ndarray:
    near, far = assign(rows, centroids, scale)
    out = np.zeros(len(centroids), object)
    np.add.at(out, near, np.array([int(d) for d in far], object))
    return out


def labelled(vectors: DataFrame, found: Clusters, dims: int = DIMS, vector: str = "embedding", columns: Sequence[str] | None = None) -> DataFrame:
    """The kept rows of `vectors` as a struct `p` of `columns` (None: all), with cluster, distance, cluster_inertia, inertia
    and centroid_sha256.

    Distances and sums beyond 64 bits are given as 2^63 - 1. Columns of any names may come along.
    """
    digests = [found.digest(j) for j in range(len(found.centroids))]
    inertia, total = [min(x, MOST_LONG) for x in found.inertia], min(sum(found.inertia), MOST_LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), dims)
            near, far = assign(rows, found.centroids, found.scale)
            far = [min(int(d), MOST_LONG) for d in far]
            near = near.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(near, pa.int32()), pa.array(far, pa.int64()), pa.array([inertia[j] for j in near], pa.int64()),
                pa.array([total] * len(near), pa.int64()), pa.array([digests[j] for j in near], pa.string()),
            ], ["p", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    rows = vectors.select(payload(vectors, columns).alias("p"), quoted(vector).cast("array<double>").alias("v")).where(_kept(F.col("v"), dims))
    more = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    schema = rows.select("p", *[F.lit(None).cast(t).alias(c) for c, t in more.items()]).schema
    return (rows if digests else rows.limit(0)).mapInArrow(run, schema)
