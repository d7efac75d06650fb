"""Centroid clustering of integer vectors by equal-average equal-variance nearest-neighbour search.

A vector of ``dim`` components x becomes integers floor(scale * x). Centroids are kept sorted by the sum of their components.
For each vector they are scanned outward from the vector's own sum, and for a vector v and a centroid c two inequalities
hold, where S is the sum of the components and D the square root of their squared deviations from their mean:

    dim * distance >= (S(v) - S(c))**2                            (equal average)
    distance >= (S(v) - S(c))**2 / dim + (D(v) - D(c))**2         (equal variance)

The first is tested in integers and ends a vector's scan, since what lies farther out has a larger difference. The second is
tested in doubles with an allowance for rounding and skips one centroid. What is left gets its exact integer distance. Among
equal distances the smaller number of a centroid wins, so an inequality must be strict to reject.

A round is one pass over the vectors. Each task adds up its own vectors by centroid, and Spark adds these sums, one row for
each centroid and component in each task; only the sums over all tasks (centroids x components) reach the driver. The vectors
are read from the table in each round, so there is nothing to lose with an executor.

Defined results: a vector that is null, of another length, or holds a null or non-finite component takes no part and is not
returned. A null id has no hash and starts no centroid, but its vector is assigned. Repeated rows are vectors each; where
hashes tie, the smaller vector (component by component) comes first. With fewer vectors than centroids there are as many
centroids as vectors with an id. Without any centroid, or in an empty table, the result is empty. A distance or a sum beyond
64 bits is null; all comparisons before it are exact at any size. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1


def safe(dim: int) -> int:
    """While all components are below this, the squares of differences of sums, times ``dim``, stay below 2**63."""
    return (1 << 30) // dim


def usable(vector: Column, dim: int) -> Column:
    """The vector has ``dim`` finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & ~odd, F.lit(False))


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers: 64 bits where all are small, else Python's."""
    with np.errstate(over="ignore"):
        grown = np.floor(vectors * scale)
    if not len(grown) or np.abs(grown).max() < safe(vectors.shape[1]):
        return grown.astype(np.int64)
    # a large double is an integer, so its product may be taken as integers
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


class Search:
    """Nearest centroid of integer vectors."""

    def __init__(self, centroids: list[list[int]]):
        big = any(abs(x) >= safe(len(c)) for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=object if big else np.int64)
        self.sums, self.deviations = self._moments(self.centroids)
        self.order = np.argsort(self.sums, kind="stable")  # equal sums: by number
        self.dim = self.centroids.shape[1]

    @staticmethod
    def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = x.sum(1)
        y = x.astype(float)
        return sums, np.sqrt(((y - y.mean(1, keepdims=True)) ** 2).sum(1))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance of each vector."""
        if x.dtype != self.centroids.dtype:
            x = x.astype(object)
        kind, k = (object if x.dtype == object or self.centroids.dtype == object else np.int64), len(self.order)
        sums, deviations = self._moments(x)
        ordered = self.sums[self.order]
        right = np.searchsorted(ordered, sums).astype(np.int64)  # first centroid with a sum at least the vector's
        left = right - 1
        best = np.full(len(x), -1, np.int64)
        distance = np.zeros(len(x), kind)
        active = np.arange(len(x))
        while len(active):
            # the nearer of the two next centroids, one on each side
            lo, hi, own = left[active], right[active], sums[active]
            gap_lo = own - ordered[np.maximum(lo, 0)]
            gap_hi = ordered[np.minimum(hi, k - 1)] - own
            up = (lo < 0) | ((hi < k) & (gap_hi < gap_lo).astype(bool))
            at, gap = np.where(up, hi, lo), np.where(up, gap_hi, gap_lo)
            left[active] -= ~up
            right[active] += up
            known, so_far = best[active] >= 0, distance[active]
            open_ = ~known | (gap * gap <= self.dim * so_far).astype(bool)
            active, at, gap, known, so_far = active[open_], at[open_], gap[open_], known[open_], so_far[open_]
            centroid = self.order[at]
            squares = gap.astype(float) ** 2 / self.dim + (deviations[active] - self.deviations[centroid]) ** 2
            # doubles err by a few units in the last place of what was subtracted
            size = (np.abs(deviations[active]) + self.deviations[centroid] + np.abs(sums[active].astype(float))) ** 2
            tried = ~known | (squares - 1e-9 * (squares + 1) - 1e-12 * size <= so_far.astype(float) * (1 + 1e-9))
            rows, centroid = active[tried], centroid[tried]
            delta = x[rows] - self.centroids[centroid]
            exact = (delta * delta).sum(1)
            known, so_far = known[tried], so_far[tried]
            better = ~known | (exact < so_far).astype(bool) | ((exact == so_far).astype(bool) & (centroid < best[rows]))
            best[rows[better]], distance[rows[better]] = centroid[better], exact[better]
            active = active[(left[active] >= 0) | (right[active] < k)]
        return best, distance


def _vectors(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return scaled(flat.reshape(-1, dim), scale)


def _sums(centroids: list[list[int]], scale: int):
    """Count and component sums of each centroid's vectors in a task; component -1 is the count."""
    dim, exact = len(centroids[0]), pa.decimal128(38, 0)
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("value", exact)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Search(centroids), len(centroids)
        totals, counts = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), dim, scale)
            best, _ = search.assign(x)
            for cluster in np.unique(best).tolist():  # a batch of small components cannot pass 64 bits
                own = x[best == cluster]
                totals[cluster] += own.sum(0).astype(object)
                counts[cluster] += len(own)
        rows = [(c, -1, int(counts[c])) for c in range(k) if counts[c]]
        rows += [(c, i, int(totals[c, i])) for c in range(k) if counts[c] for i in range(dim)]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(map(Decimal, columns[2]), exact)],
            schema=schema,
        )

    return run


def _assigned(centroids: list[list[int]], scale: int):
    """Each vector's centroid and distance."""
    dim = len(centroids[0])
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            best, distance = search.assign(_vectors(batch.column(1), dim, scale))
            exact = pa.array([d if d <= LONG else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), exact], schema=schema)

    return run


def _seeds(base: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors whose id has the smallest hashes."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    rows = base.filter("id IS NOT NULL").select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return [scaled(np.array([r["vector"]], float), scale)[0].tolist() for r in rows]


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """``id_col, cluster, distance`` of each vector that takes part, and the final centroids.

    ``k * dim`` numbers are broadcast and collected in each round, whatever the number of vectors.
    """
    base = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).filter(usable(F.col("vector"), dim))
    centroids = _seeds(base, k, seed, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"{id_col} long, cluster int, distance long"), []
    for _ in range(rounds):
        parts = base.select("vector").mapInArrow(_sums(centroids, scale), "cluster int, part int, value decimal(38,0)")
        found = {(r["cluster"], r["part"]): int(r["value"]) for r in parts.groupBy("cluster", "part").agg(
            F.sum("value").alias("value")).collect()}
        centroids = [
            [found[c, i] // found[c, -1] for i in range(dim)] if (c, -1) in found else old for c, old in enumerate(centroids)
        ]
    out = base.mapInArrow(_assigned(centroids, scale), "id long, cluster int, distance long")
    return out.withColumnRenamed("id", id_col), centroids


def digest(centroid: list[int]) -> str:
    """Lower-case hex SHA-256 of the components, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """``cluster``'s rows with the inertia of their cluster and of all, and the digest of their centroid."""
    rows, centroids = cluster(vectors, id_col=id_col, **options)
    by = rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"),
        F.max(F.col("distance").isNull()).alias("unknown"),
    ).collect()  # one row a centroid
    sums = {r["cluster"]: None if r["unknown"] else int(r["inertia"]) for r in by}
    total = None if None in sums.values() else sum(sums.values())
    within = lambda x: x if x is not None and x <= LONG else None
    facts = rows.sparkSession.createDataFrame(
        [(c, within(sums.get(c, 0)), within(total), digest(x)) for c, x in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(facts), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
