"""Centroid clustering of integer vectors in which stored pivot distances spare most exact distances.

Every vector's distances to a few fixed pivots are computed once and written with it (the pivot table of LAESA). A round
knows the centroids' distances to the same pivots; by the triangle inequality the largest difference over the pivots is a
lower bound of the distance of vector and centroid. The centroid with the lowest bound is measured first; after that only
centroids whose bound does not exceed the best measured distance are, exactly and in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.stage import stage
from .common import keyed

#: Vectors measured at once. Integers beyond LARGEST could overflow a squared distance of up to 64 dimensions in 64 bits.
_BLOCK = 4096
LARGEST = 1 << 27
#: Relative rounding of a bound: a centroid is left out only where it is farther by more than this.
_SLACK = 1e-9


@dataclass
class Clusters:
    """What ``cluster`` returns: rows vec_id, cluster, distance; the final centroids; exact distances by round and all possible."""
    rows: DataFrame
    centroids: np.ndarray
    measured: list[int]
    possible: int


def integers(df: DataFrame, vec_id: str, vector: str, dims: int, scale: float) -> DataFrame:
    """vec_id, x (array of longs: floor(scale * component), components as doubles) of the vectors that take part.

    These have exactly ``dims`` components, none of them null, infinite or not a number.
    """
    v = F.col("v")
    whole = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    src = keyed(df, vec_id, vector).toDF("vec_id", "v").withColumn("v", v.cast("array<double>"))
    return src.where(v.isNotNull() & whole).select("vec_id", F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def drawn(seed: int, vec_id: str = "vec_id") -> Column:
    """Lower-case hexadecimal sha256 of the seed, a colon and the id in decimal; null without an id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n pivots of the sample: each has the largest summed distance to those before it (the first: to the mean)."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    total = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
    chosen: list[int] = []
    while len(chosen) < min(n, len(x)):
        best = int(np.argmax(total))
        near = np.sqrt(((x - x[best]) ** 2).sum(1))
        total = near if not chosen else total + near
        chosen.append(best)
        total[chosen] = -1
        if total.max() <= 0:
            break
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1).astype(np.float64))
    return out


def assign(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), squared distance, and how many exact distances it took."""
    n, k = len(x), len(centroids)
    cluster, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    measured = 0
    reach = to_pivots(centroids, pivots)
    for at in range(0, n, _BLOCK):
        v, own = x[at:at + _BLOCK], table[at:at + _BLOCK]
        bound = np.zeros((len(v), k))
        for j in range(reach.shape[1]):
            np.maximum(bound, np.abs(own[:, j, None] - reach[None, :, j]), out=bound)
        first = bound.argmin(1)
        least = ((v - centroids[first]) ** 2).sum(1)
        nearest = first.copy()
        measured += len(v)
        # centroids in order: a later one wins only if it is nearer, or as near and smaller than the first one measured
        for c in range(k):
            rows = np.flatnonzero((first != c) & (bound[:, c] * (1 - _SLACK) <= np.sqrt(least.astype(np.float64)) * (1 + _SLACK) + _SLACK))
            if not len(rows):
                continue
            measured += len(rows)
            far = ((v[rows] - centroids[c]) ** 2).sum(1)
            wins = (far < least[rows]) | (far == least[rows]) & (c < nearest[rows])
            least[rows[wins]], nearest[rows[wins]] = far[wins], c
        cluster[at:at + len(v)], best[at:at + len(v)] = nearest, least
    return cluster, best, measured


def _matrix(column: pa.ListArray, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(-1, width)


def _indexed(vectors: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """The pivot table: vec_id, x and the distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims, np.int64)
            if len(x) and max(x.max(), -(x.min() + 1)) >= LARGEST:
                raise ValueError(f"a component beyond {LARGEST} after scaling: squared distances would not fit 64 bits")
            d = to_pivots(x, pivots)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), near], names=["vec_id", "x", "near"])

    return vectors.mapInArrow(run, "vec_id long, x array<long>, near array<double>")


def _sums(index: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Componentwise sums and counts of the clusters, added up in the tasks and then in Spark: k rows reach the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, measured = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column("x"), dims, np.int64)
            cluster, _, m = assign(x, _matrix(batch.column("near"), len(pivots), np.float64), centroids, pivots)
            measured += m
            count += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            own, at = np.unique(cluster[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(x[order], at, axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array([measured if i == 0 else 0 for i in range(len(some))], pa.int64()), *(pa.array(sums[some, d]) for d in range(dims))],
            names=["cluster", "n", "measured", *(f"s{d}" for d in range(dims))])

    parts = index.select("x", "near").mapInArrow(run, "cluster int, n long, measured long, " + ", ".join(f"s{d} long" for d in range(dims)))
    total, count, measured = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
    for r in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in parts.columns[1:])).collect():
        total[r["cluster"]], count[r["cluster"]] = r[3:], r["n"]
        measured += r["measured"]
    return total, count, measured


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0, pivots: int = 16,
            sample: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Vectors made integers, ``rounds`` of assignment and floor means from hash-drawn starts, and a last assignment.

    Starts are the ``k`` vectors whose hashed ids (``drawn``) are smallest; with fewer vectors there are fewer clusters.
    Vectors with equal ids are vectors of their own, ordered among each other by their components. Those without an id are
    assigned like any other and become starts only where too few have one. Vectors that are null, of another length, or
    with null or non-finite components take no part; an empty table gives an empty result. A component beyond 2^27 after
    scaling stops the job. Pivots are the most spread of ``sample`` hash-drawn vectors: they set the work, not the result.
    """
    vectors = integers(df, vec_id, vector, dims, scale)
    drawn_rows = vectors.orderBy(drawn(seed).asc_nulls_last(), "x").limit(max(k, sample)).select("x").collect()
    first = np.array([r["x"] for r in drawn_rows], np.int64).reshape(-1, dims)
    centroids, fixed = first[:k].copy(), spread(first, pivots)
    if not len(centroids):
        return Clusters(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, [], 0)
    index = stage(_indexed(vectors, fixed, dims), "pivots")
    measured, possible = [], 0
    for _ in range(rounds):
        total, count, m = _sums(index, centroids, fixed)
        some = count > 0
        centroids = np.where(some[:, None], total // np.maximum(count, 1)[:, None], centroids)
        measured.append(m)
        possible += int(count.sum()) * len(centroids)
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, d, _ = assign(_matrix(batch.column("x"), dims, np.int64), _matrix(batch.column("near"), len(fixed), np.float64), last, fixed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(c, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return Clusters(index.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids, measured, possible)


def described(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, and of every row's cluster cluster_inertia, inertia (distances added up over the cluster
    and over all vectors) and centroid, the components of its final centroid as integers joined by commas."""
    spark = found.rows.sparkSession
    rows = stage(found.rows, "clusters")
    per = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(c, per[c], sum(per.values()), ",".join(map(str, x))) for c, x in enumerate(found.centroids.tolist()) if c in per]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid string")
    # one row a cluster, made on the driver
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
