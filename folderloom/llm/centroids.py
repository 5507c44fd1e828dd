"""Centroid clustering in whole numbers, by equal-average equal-variance nearest-centroid search.

Vectors of ``dim`` components become integers floor(``scale`` * x). Centroids are sorted by their component sum (their mean
times ``dim``); each vector scans them outward from its own sum. With s the sums and v the roots of dim * sum(x^2) - s^2
(deviations times ``dim``), dim * distance >= (difference of s)^2 + (difference of v)^2. So

1. the scan ends where the squared difference of sums alone exceeds dim * (best distance so far): all further ones are worse;
2. a centroid is skipped where both squares together exceed it; v is bracketed by whole roots, so nothing is rounded;
3. what is left gets its exact squared distance; ties go to the smaller centroid number, as equal bounds are never skipped.

Scans run over Arrow batches, all vectors of a batch side by side. A round moves one row per batch and centroid (count and
component sums); only the centroids, a table bounded by ``k`` x ``dim``, are broadcast and come to the driver. Kept vectors are
staged once, so a lost executor costs its tasks only.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part; components beyond
2^27 after scaling count as 2^27, so that every squared distance fits a long; the first centroids are the vectors of smallest
sha256 of "``seed``:id", ties by components, rows without id never; with fewer vectors than ``k`` there are fewer
centroids, with no usable id none and no rows; repeated rows count each; a row without id is assigned like the others; an
inertia that does not fit a long is null; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folderloom.plans.staging import Stage

BOUND = 1 << 27
_LARGEST = np.iinfo(np.int64).max


def _roots(a: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    if a.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(a)
    r = np.sqrt(a.astype(np.float64)).astype(np.int64)
    r -= r * r > a
    return r + ((r + 1) * (r + 1) <= a)


class Centroids:
    """Centroids in the order of their component sums, with what the two inequalities need."""

    def __init__(self, vectors: list[list[int]]):
        x = np.array(vectors, np.int64)
        self.order = np.argsort(x.sum(axis=1), kind="stable")
        self.x = x[self.order]
        self.largest = int(np.abs(x).max(initial=0))
        self.dim = x.shape[1]
        self.visited = 0

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x.sum(axis=1)
        return s, _roots(self.dim * (x * x).sum(axis=1) - s * s)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its squared distance, for each row of whole numbers."""
        wide = (2 * max(self.largest, int(np.abs(x).max(initial=0))) * self.dim) ** 2 >= 1 << 61
        kind = object if wide else np.int64  # beyond 64 bits, Python's whole numbers go the same way
        x, c = x.astype(kind), self.x.astype(kind)
        s, low = self._features(x)
        cs, clow = self._features(c)
        n, k = len(x), len(c)
        number, best = np.full(n, -1, np.int64), np.zeros(n, kind)
        limit = np.full(n, _LARGEST if kind is np.int64 else 1 << 200, kind)
        right = np.searchsorted(cs, s)
        left, rows = right - 1, np.arange(n)
        for _ in range(k):
            l, r = left[rows], right[rows]
            gap_l, gap_r = s[rows] - cs[np.maximum(l, 0)], cs[np.minimum(r, k - 1)] - s[rows]
            down = (l >= 0) & ((r >= k) | (gap_l <= gap_r))
            at, gap = np.where(down, l, r), np.where(down, gap_l, gap_r)
            going = (gap * gap <= limit[rows]).astype(bool)
            rows, at, gap, down = rows[going], at[going], gap[going], down[going]
            left[rows] -= down
            right[rows] += ~down
            apart = np.maximum(0, np.maximum(low[rows] - clow[at] - 1, clow[at] - low[rows] - 1))
            near = (gap * gap + apart * apart <= limit[rows]).astype(bool)
            some, at = rows[near], at[near]
            self.visited += len(some)
            distance = ((x[some] - c[at]) ** 2).sum(axis=1)
            named = self.order[at]
            better = (number[some] < 0) | (distance < best[some]) | ((distance == best[some]) & (named < number[some]))
            better = better.astype(bool)
            some, distance = some[better], distance[better]
            number[some], best[some], limit[some] = named[better], distance, distance * self.dim
        return number.astype(np.int32), best.astype(np.int64)


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("q").flatten(), np.int64).reshape(-1, dim)


def _sums(centroids):
    def run(batches):
        for batch in batches:
            c = centroids.value
            x = _whole(batch, c.dim)
            number, _ = c.nearest(x)
            used, at = np.unique(number, return_inverse=True)
            sums = np.zeros((len(used), c.dim), np.int64)
            np.add.at(sums, at, x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.bincount(at, minlength=len(used)).astype(np.int64)),
                 pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids):
    def run(batches):
        for batch in batches:
            number, distance = centroids.value.nearest(_whole(batch, centroids.value.dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, q) of the vectors that take part; q holds floor(scale * x)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v")).where(
        (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))
    return kept.select("id", whole.alias("q"))


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16,
            rounds: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids): (id, cluster, distance) of every kept vector, and (cluster, centroid, cluster_inertia, inertia)."""
    spark = vectors.sparkSession
    stage, context = Stage(spark), spark.sparkContext
    kept = stage.keep(whole_vectors(vectors, vec_id, vector, dim, scale), "kept")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.where(F.col("id").isNotNull()).orderBy(place, "q").limit(k).select("q").collect()
    centres = [list(r.q) for r in first]
    kind = kept.schema["id"].dataType.simpleString()
    if not centres:
        return (spark.createDataFrame([], f"id {kind}, cluster int, distance long"),
                spark.createDataFrame([], "cluster int, centroid array<long>, cluster_inertia long, inertia long"))
    for _ in range(rounds):
        moved = kept.mapInArrow(_sums(context.broadcast(Centroids(centres))), "cluster int, n long, sums array<long>")
        sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)])
        for r in moved.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # at most k rows
            centres[r.cluster] = [x // r.n for x in r.sums]
    last = context.broadcast(Centroids(centres))
    found = stage.keep(kept.mapInArrow(_assigned(last), f"id {kind}, cluster int, distance long"), "found")
    spent = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    total = fits(sum(spent.values()))
    table = [(i, c, fits(spent.get(i, 0)), total) for i, c in enumerate(centres)]
    return found, spark.createDataFrame(table, "cluster int, centroid array<long>, cluster_inertia long, inertia long")

