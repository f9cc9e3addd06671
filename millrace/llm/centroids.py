"""Centroid clustering: Lloyd's rounds over integer vectors, nearest centroids by annulus search.

A vector is no nearer to a centroid than their norms differ. So with centroids
sorted by norm and any upper bound of a vector's least distance, only the
centroids whose norms lie within that bound of the vector's norm can be nearest:
two binary searches give them, and they alone are compared, in exact integers.
The bound is the distance to the nearer of the two centroids that neighbour the
vector by norm. The annulus is widened by what rounding of norms may change, so
centroids on its border, ties among them, are compared as well.

Vectors are scaled and floored once and written to the shared folder; every round
is one pass over that table, whose tasks stream batches and give one row of sums a
centroid. Sums of tasks are added in Spark as decimals; only the ``k`` centroids
reach the driver and go out to tasks, which the parameters bound.

Defined cases: vectors that are null, of another length than ``width``, or hold a
null, NaN or infinity take no part; nor do those with a scaled component beyond
``LIMIT``, whose squared distances may not fit a long. Rows that repeat an id, or
have none, count as often as they come; rows without an id start a centroid only
if others are too few, rows of one id in order of their vectors. Fewer vectors
than ``k`` give fewer centroids, none give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

#: Largest size of a scaled component: 64 squares of differences of two such fit a long.
LIMIT = 1 << 27
#: Pairs of a vector and a centroid that are compared at once.
PAIRS = 1 << 15


class Annulus:
    """Centroids sorted by norm, for exact nearest-centroid searches."""

    def __init__(self, centroids: np.ndarray):
        size = (centroids**2).sum(1)
        self.number = np.argsort(size, kind="stable")
        self.centroids, self.norms = centroids[self.number], np.sqrt(size[self.number])

    def ranges(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector, from and to which place in order of norms its nearest centroids are."""
        norms, last = np.sqrt((vectors**2).sum(1)), len(self.norms) - 1
        above = np.searchsorted(self.norms, norms)
        beside = [((vectors - self.centroids[np.clip(at, 0, last)]) ** 2).sum(1) for at in (above - 1, above)]
        bound = np.sqrt(np.minimum(*beside))
        bound += 1e-9 * (norms + bound) + 1e-6
        return np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid's number and its squared distance; the smaller number wins ties."""
        n = len(vectors)
        number, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = self.ranges(vectors)
        ends = np.cumsum(high - low)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            many = (high - low)[start:end]
            first = np.append(0, np.cumsum(many)[:-1])
            at = np.arange(many.sum()) + np.repeat(low[start:end] - first, many)
            far = ((np.repeat(vectors[start:end], many, 0) - self.centroids[at]) ** 2).sum(1)
            least = np.minimum.reduceat(far, first)
            tied = np.where(far == np.repeat(least, many), self.number[at], len(self.number))
            number[start:end], distance[start:end] = np.minimum.reduceat(tied, first), least
            start = end
        return number, distance


def scaled_vectors(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", width: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: floors of the scaled components of all vectors that take part."""
    v = F.col(column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.size("v") == width)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / scale))
    return rows.filter(fine).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose seeded ids have the least hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means; those without vectors stay."""
    width = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, count, total = Annulus(centroids), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0), width)
            number, _ = search.nearest(rows)
            by = np.argsort(number, kind="stable")
            met, first = np.unique(number[by], return_index=True)
            total[met] += np.add.reduceat(rows[by], first)
            count += np.bincount(number, minlength=len(count))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(work, "cluster int, n bigint, total array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("place", "total")).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) of every vector."""
    width = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            number, distance = search.nearest(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(work, "vec_id bigint, cluster int, distance bigint")


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid`` of every vector that takes part."""
    spark = embeddings.sparkSession
    vectors = written(scaled_vectors(embeddings, width=width, scale=scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = written(assigned(vectors, centroids), "assigned")
    sums = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, at.tolist())).encode()).hexdigest(), at.tolist()) for c, at in enumerate(centroids)]
    # One row a centroid.
    return found.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
