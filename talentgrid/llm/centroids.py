"""Centroid clustering of vectors in exact integers by equal-average equal-variance nearest neighbour search.

Centroids are sorted by the mean of their components. A vector's scan starts at its own mean and goes outward; it ends
where the difference of means alone exceeds the best distance so far, and skips centroids that the differences of mean
and deviation together rule out. Only what remains is measured, in integers. Both bounds are taken in floating point with
room for its rounding, so no nearest centroid is lost, and ties go to the smaller number. A round is one pass over the
vectors: tasks assign batches and add them up per cluster, and only sums per cluster and component leave them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.session import cut

BATCH = 4096
LARGEST = 1 << 27  # of a component's amount after scaling, so that squared distances fit in 64 bits


class Centroids:
    """Centroids (k, dims) in the order of their means, ready for scans."""

    def __init__(self, values: np.ndarray):
        sums = values.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.values, self.sums = values[self.order], sums[self.order]
        self.spread = _spread(self.values)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance to it, of each row of `vectors` (int64)."""
        n, dims, k = len(vectors), vectors.shape[1], len(self.values)
        sums, spread = vectors.sum(1), _spread(vectors)
        best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        high = np.searchsorted(self.sums, sums)  # next centroid to look at on each side
        low = high - 1
        open_ = np.arange(n)
        while len(open_):
            below, above = low[open_], high[open_]
            gap_below = np.where(below >= 0, sums[open_] - self.sums[np.maximum(below, 0)], np.iinfo(np.int64).max)
            gap_above = np.where(above < k, self.sums[np.minimum(above, k - 1)] - sums[open_], np.iinfo(np.int64).max)
            down = gap_below <= gap_above
            at, gap = np.where(down, below, above), np.where(down, gap_below, gap_above)
            by_mean = gap.astype(float) ** 2 / dims
            going = (at >= 0) & (at < k) & (by_mean * (1 - 1e-9) <= best[open_])
            open_, at, by_mean = open_[going], at[going], by_mean[going]
            low[open_] -= down[going]
            high[open_] += ~down[going]
            apart = np.maximum(np.abs(spread[open_] - self.spread[at]) - 1e-6, 0)
            near = (by_mean + apart**2) * (1 - 1e-9) <= best[open_]
            rows, at = open_[near], at[near]
            far, number = ((vectors[rows] - self.values[at]) ** 2).sum(1), self.order[at]
            better = (far < best[rows]) | (far == best[rows]) & (number < which[rows])
            best[rows[better]], which[rows[better]] = far[better], number[better]
        return which, best


def _spread(values: np.ndarray) -> np.ndarray:
    """Root of the summed squared differences to each row's mean."""
    return np.sqrt(((values - values.mean(1, keepdims=True)) ** 2).sum(1))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Vectors and component sums of each cluster that is not empty: at most as many rows as centroids reach the driver."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Centroids(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in _batches(batches):
            own = _matrix(batch.column("ints"), dims)
            cluster, _ = search.nearest(own)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, own)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("ints").mapInArrow(add, "cluster long, n long, sums array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]).collect()
    return {r.cluster: r.n for r in whole}, {r.cluster: list(r)[2:] for r in whole}


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    kind, dims = dict(vectors.dtypes)["vec_id"], centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in _batches(batches):
            cluster, far = search.nearest(_matrix(batch.column("ints"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "ints").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def whole_vector(vector: Column, dims: int) -> Column:
    """Whether the vector has `dims` components, all there and finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def clusters(
    rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every whole vector of `rows`, and the final centroids.

    Components become floor(scale * x); vectors of another length, or with a null or non-finite component, take no part.
    The first centroids are the vectors whose sha256 of `seed:id` is smallest (ties by components, rows without id last);
    with fewer vectors than `k`, each starts one. A round assigns all vectors and moves every centroid to the floor of
    its vectors' mean; one without vectors stays. Rows that repeat an id or a vector count each. An empty table gives an
    empty result without centroids; other columns are not read. Scaled components beyond 2 ** 27 raise an error, since
    their squared distances do not fit in 64 bits.
    """
    values = F.col("vector")
    scaled = F.transform(values, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    bounded = F.when(F.forall("ints", lambda x: F.abs(x) <= LARGEST), F.col("ints")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} exceeds {LARGEST}")))
    vectors = cut(
        rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(whole_vector(values, dims))
        .select("vec_id", scaled.alias("ints")).withColumn("ints", bounded))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(hashed.asc_nulls_last(), "ints").limit(k).collect()
    centroids = np.array([r.ints for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        counts, sums = _sums(vectors, centroids)
        centroids = np.array([[s // counts[c] for s in sums[c]] if c in counts else list(old) for c, old in enumerate(centroids)], np.int64)
    return cut(_assigned(vectors, centroids)), centroids.tolist()


def cluster_report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every assigned vector."""
    spark = assigned.sparkSession
    sums = {r.cluster: r.far for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}  # a row per centroid at most
    named = [
        (c, sums.get(c, 0), sum(sums.values()), sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    known = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
