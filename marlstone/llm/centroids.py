"""Centroid clustering by annulus search, in whole numbers: a vector's norm and an upper bound of its distance from the
nearest centroid bound the norms that its nearest centroid can have; a binary search over centroids sorted by norm finds
those, and only they are compared, exactly and with ties.

Rounds send the centroids to the tasks and get one row of counts and sums a task and centroid back, summed up by Spark:
what reaches the driver is k rows, whatever the number of vectors, and a cluster of any size burdens no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import map_slices, ship, slices

#: Largest whole number of a component, and the most centroids times components: what is sent to every task.
LIMIT, MOST = 1 << 27, 1 << 22
#: Vectors of neighbouring norms that are compared at once, and rows of a slice.
TILE, ROWS = 128, 4096


class Annulus:
    """Centroids of whole components, sorted by norm."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers.astype(np.int64)
        self.square = (self.centers**2).sum(1)
        self.order = np.lexsort((np.arange(len(centers)), self.square))
        self.norm = np.sqrt(self.square[self.order].astype(np.float64))
        self.largest = int(np.abs(self.centers).max(initial=0))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of whole numbers; ties go to the smaller number."""
        k, (m, d) = len(self.order), x.shape
        square = (x * x).sum(1)
        norm = np.sqrt(square.astype(np.float64))
        # an upper bound: the distance from the centroid whose norm is nearest
        right = np.clip(np.searchsorted(self.norm, norm), 0, k - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(np.abs(self.norm[left] - norm) <= np.abs(self.norm[right] - norm), left, right)
        bound = np.sqrt(((x - self.centers[self.order[near]]) ** 2).sum(1).astype(np.float64))
        slack = 1e-9 * (norm + self.norm[-1] + bound) + 1e-6  # more than rounding can make: a centroid on the border is within
        low = np.searchsorted(self.norm, norm - bound - slack, "left")
        high = np.searchsorted(self.norm, norm + bound + slack, "right")
        # products of doubles are exact as long as their sums stay below 2**53
        kind = np.float64 if 4 * d * max(self.largest, int(np.abs(x).max(initial=0))) ** 2 < 1 << 53 else np.int64
        number, distance = np.empty(m, np.int64), np.empty(m, np.int64)
        by_norm = np.argsort(norm, kind="stable")
        for at in range(0, m, TILE):
            rows = by_norm[at : at + TILE]
            a, b = int(low[rows].min()), int(high[rows].max())
            names = self.order[a:b]
            dots = (x[rows].astype(kind) @ self.centers[names].T.astype(kind)).astype(np.int64)
            away = square[rows, None] + self.square[names] - 2 * dots
            place = np.arange(a, b)
            away[(place < low[rows, None]) | (place >= high[rows, None])] = np.iinfo(np.int64).max
            distance[rows] = away.min(1)
            number[rows] = np.where(away == distance[rows, None], names, k).min(1)
        return number, distance


def _floored(values: np.ndarray, scale: int) -> np.ndarray:
    made = np.floor(values * scale)
    if np.abs(made).max(initial=0) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT / scale}: squared distances would not fit a long")
    return made.astype(np.int64)


def whole(batch: pa.RecordBatch, dimensions: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """vec_id and floor(scale * component) of the vectors that are kept."""
    vectors = batch.column("embedding")
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False)
    values = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    finite = np.isfinite(values).all(1)
    return batch.column("vec_id").filter(fits).filter(pa.array(finite)), _floored(values[finite], scale)


def first_centroids(vectors: DataFrame, k: int, dimensions: int, scale: int, salt: str) -> np.ndarray:
    """The k kept vectors whose `salt:vec_id` has the least SHA-256, in this order; repeated ids by their components."""
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where((F.size(e) == dimensions) & good & F.col("vec_id").isNotNull()).select(key.alias("key"), e).orderBy("key", "embedding").limit(k).collect()
    return _floored(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dimensions), scale)


def _sums(vectors: DataFrame, centers: np.ndarray, dimensions: int, scale: int) -> list:
    """(cluster, n, sums) of one round: each task adds up its own, and Spark adds up the tasks'."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(sent.value)
        n, total = np.zeros(len(near.order), np.int64), np.zeros(near.centers.shape, np.int64)
        for batch in batches:
            for part in slices(batch, ROWS, 1 << 22):
                _, x = whole(part, dimensions, scale)
                if len(x):
                    own, _ = near.assign(x)
                    by = np.argsort(own, kind="stable")
                    present, start = np.unique(own[by], return_index=True)
                    n += np.bincount(own, minlength=len(n))
                    total[present] += np.add.reduceat(x[by], start, axis=0)
        there = np.flatnonzero(n)
        flat = pa.array(total[there].ravel(), pa.int64())
        ends = pa.array(np.arange(len(there) + 1) * dimensions, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), pa.ListArray.from_arrays(ends, flat)], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(dimensions)])
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums")).collect()  # a row a centroid
    sent.unpersist()
    return rows


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that is kept.

    Kept are vectors of exactly `dimensions` components, none null or non-finite; components become floor(scale * x). The
    first centroids are the k kept vectors of least SHA-256 of `salt:vec_id`. Each round assigns every vector to its
    nearest centroid (squared distance, ties to the smaller number) and replaces each centroid that has vectors by their
    componentwise floor(sum / n); then they are assigned once more. All of it is exact.

    Rows that repeat are vectors each; a null vec_id takes part but starts no centroid. Fewer than k vectors start as many
    centroids; none at all give no rows. Components beyond LIMIT / scale raise. Other columns are not read. Every round
    reads `vectors` anew: write what is costly to make. At most MOST numbers of centroids are sent to a task.
    """
    if k * dimensions > MOST:
        raise ValueError(f"more than {MOST} numbers of centroids")
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    schema = "vec_id long, cluster int, distance long"
    centers = first_centroids(vectors, k, dimensions, scale, salt)
    if not len(centers):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        moved = centers.copy()
        for r in _sums(vectors, centers, dimensions, scale):
            moved[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        centers = moved
    assigned = written(map_slices(vectors, _assigning(centers, dimensions, scale), schema, rows=ROWS, limit=1 << 22))
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    told = spark.createDataFrame([(c, s, sum(own.values()), digest[c]) for c, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def _assigning(centers: np.ndarray, dimensions: int, scale: int) -> Callable:
    def make():
        near = Annulus(centers)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, x = whole(batch, dimensions, scale)
            number, distance = near.assign(x) if len(x) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

        return fn

    return make
