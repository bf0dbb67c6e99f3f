"""Centroid clustering by exponion search, in whole numbers.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other.
A round moves the bounds by what the centroids have moved.  Only where they no longer decide, the vector scans the centroids
inside a ball around its own one, found in that centroid's sorted list of distances to the others; the ball includes
its surface, so ties are seen.  The vectors stay where they are: a round writes them with their bounds, and only sums of
each cluster leave a partition.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import checkpointed

CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Components below this in size are handled as 64-bit integers, larger ones as integers without bound.
SMALL = 1 << 26
#: Bounds are kept apart by this share, far above the rounding of doubles.
SLACK = 1e-12
ROWS = 8192


def whole(values: np.ndarray) -> np.ndarray:
    """floor(64 x) of finite doubles, as integers: 64-bit ones where all are small."""
    values = np.asarray(values, np.float64)
    if not values.size or np.abs(values).max() < SMALL / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    out = [[int(v) * SCALE if abs(v) >= 2**52 else math.floor(v * SCALE) for v in row] for row in values.tolist()]
    return np.array(out, object)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


class Centroids:
    """Centroids with, for each, the others in the order of their distance, and how far each has moved."""

    def __init__(self, values: list[list[int]]):
        big = any(abs(v) >= SMALL for row in values for v in row)
        self.values = np.array(values, object if big else np.int64).reshape(len(values), -1)
        self.moved = np.zeros(len(values))
        self.big = big
        if not big:
            far = np.sqrt(((self.values[:, None, :] - self.values[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
            np.fill_diagonal(far, -1)
            self.order = np.argsort(far, axis=1, kind="stable")[:, 1:]
            self.near = np.take_along_axis(far, self.order, axis=1)

    def next(self, values: list[list[int]]) -> Centroids:
        """The centroids after a move."""
        new = Centroids(values)
        bounded = not self.big and not new.big
        new.moved = np.array([math.dist(a, b) * (1 + SLACK) if bounded else math.inf for a, b in zip(self.values.tolist(), values)])
        return new

    def plain(self, x: np.ndarray):
        """Nearest centroid (ties: the smaller number) and bounds from a scan of all of them."""
        every = np.stack([squares(x, c) for c in self.values], axis=1)
        if every.dtype == object:
            own = np.array([min(range(len(row)), key=lambda j: (row[j], j)) for row in every.tolist()], np.int32)
            return own, np.full(len(x), np.inf), np.zeros(len(x))
        own = np.argmin(every, axis=1).astype(np.int32)
        upper = np.sqrt(every[np.arange(len(x)), own]) * (1 + SLACK)
        every[np.arange(len(x)), own] = np.iinfo(np.int64).max
        return own, upper, np.sqrt(every.min(axis=1)) * (1 - SLACK)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same from the assignment and the bounds of the round before."""
        if self.big or x.dtype == object:
            return self.plain(x)
        if len(self.values) == 1:
            return own, upper, lower
        own, upper = own.copy(), upper + self.moved[own]
        others = np.where(np.argmax(self.moved) == own, np.partition(self.moved, -2)[-2], self.moved.max())
        lower = lower - others * (1 + SLACK)
        least = np.maximum(lower, self.near[own, 0] / 2 * (1 - SLACK))
        rest = np.flatnonzero(~(upper < least))
        upper[rest] = np.sqrt(squares(x[rest], self.values[own[rest]])) * (1 + SLACK)
        rest = rest[~(upper[rest] < least[rest])]
        for a in np.unique(own[rest]).tolist():
            rows = rest[own[rest] == a]
            ball = (2 * upper[rows] + self.near[a, 0]) * (1 + SLACK)
            inside = np.searchsorted(self.near[a], ball, "right")
            best, who = squares(x[rows], self.values[a]), np.full(len(rows), a, np.int32)
            second = np.full(len(rows), np.iinfo(np.int64).max)
            for j in range(int(inside.max())):
                to, at = self.order[a, j], np.flatnonzero(inside > j)
                far = squares(x[rows[at]], self.values[to])
                nearer = (far < best[at]) | ((far == best[at]) & (to < who[at]))
                second[at] = np.where(nearer, best[at], np.minimum(second[at], far))
                best[at], who[at] = np.where(nearer, far, best[at]), np.where(nearer, to, who[at])
            own[rows], upper[rows], lower[rows] = who, np.sqrt(best) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        return own, upper, lower


def _vectors(column: pa.ListArray, size: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _assigned(centroids: Centroids, size: int, first: bool):
    def run(batches):
        for part in _slices(batches):
            x = _vectors(part.column("v"), size)
            if not first:
                state = [part.column(n).to_numpy(zero_copy_only=False) for n in ("own", "upper", "lower")]
            own, upper, lower = centroids.plain(x) if first else centroids.assign(x, *state)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower)], names=["id", "v", "own", "upper", "lower"])

    return run


def _sums(size: int):
    """Number and sums of the vectors of each cluster in the partition; the sums as decimal text, they have no bound."""

    def run(batches):
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for part in _slices(batches):
            x, own = _vectors(part.column("v"), size), part.column("own").to_numpy(zero_copy_only=False)
            for a in np.unique(own).tolist():
                rows = x[own == a]
                n[a] = n.get(a, 0) + len(rows)
                total[a] = total.get(a, 0) + rows.sum(axis=0).astype(object)
        yield _sum_rows(n, total)

    return run


def _sum_rows(n: dict, total: dict) -> pa.RecordBatch:
    keys = sorted(n)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n[k] for k in keys], pa.int64()), pa.array([[str(v) for v in total[k]] for k in keys], pa.list_(pa.string()))], names=["own", "n", "total"])


def _merged(batches):
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for own, k, values in zip(*(batch.column(c).to_pylist() for c in ("own", "n", "total"))):
            n[own] = n.get(own, 0) + k
            total[own] = total.get(own, 0) + np.array([int(v) for v in values], object)
    yield _sum_rows(n, total)


_SUMS = "own int, n bigint, total array<string>"


def cluster_sums(state: DataFrame, size: int) -> list:
    """One row of number and sums for each cluster: added up in each partition, then in parts, then for each cluster."""
    parts = state.mapInArrow(_sums(size), _SUMS).repartition("own", F.pmod(F.spark_partition_id(), F.lit(64))).mapInArrow(_merged, _SUMS)
    return parts.repartition("own").mapInArrow(_merged, _SUMS).collect()


def clusters(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` (squared) of every kept vector, and the final centroids.

    Kept are vectors of exactly ``size`` components, none null or non-finite, in whole numbers floor(64 x); others have
    no row.  The ``k`` first centroids are the kept vectors of the least sha256 of ``1:<id>`` (null ids last, equal ids by
    their vector); with fewer vectors there are fewer centroids.  Ties go to the smaller number, also between equal
    centroids; centroids without vectors stay.  Repeated rows are vectors of their own.  An empty table gives no rows
    and no centroids.  Components may have any size: beyond 2**26 integers without bound are used and all centroids
    compared; a distance that no long can hold is null.  Of the columns only the two named ones are read.
    """
    v = F.col(embedding)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    kept = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).where((F.size(v) == size) & finite)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"id {kinds['id']}, v {kinds['v']}, own int, upper double, lower double"
    name = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    start = kept.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return kept.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    centroids = Centroids(whole([r.v for r in start]).tolist())
    state = kept.mapInArrow(_assigned(centroids, size, True), schema)
    for _ in range(rounds):
        state = checkpointed(state)
        values = [list(c) for c in centroids.values.tolist()]
        for r in cluster_sums(state, size):
            values[r.own] = [int(s) // r.n for s in r.total]
        centroids = centroids.next(values)
        state = state.mapInArrow(_assigned(centroids, size, False), schema)
    last = centroids

    def measured(batches):
        for part in _slices(batches):
            x, own = _vectors(part.column("v"), size), part.column("own").to_numpy(zero_copy_only=False)
            far = squares(x, last.values[own]).tolist() if len(own) else []
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("own"), pa.array([d if d < 1 << 63 else None for d in far], pa.int64())], names=["id", "cluster", "distance"])

    return checkpointed(state.mapInArrow(measured, f"id {kinds['id']}, cluster int, distance bigint")), centroids.values.tolist()


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Contract query 12 over all vectors; sums that no long can hold are null."""
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect() if r.n is not None}
    whole_sum = sum(inertia.values())
    fit = lambda n: n if n is not None and n < 1 << 63 else None
    facts = [(k, fit(inertia.get(k)), fit(whole_sum), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
