"""Approximate nearest neighbours: inverted lists whose candidates are scanned adaptively by blocks of rotated dimensions.

An index is fitted on a bounded sample (k-means centres, and the number of lists to probe that reaches a wanted recall on
that sample); every vector is then assigned to a list. A query probes that number of lists, its nearest ones, and goes on
until they hold ``enough * (k + 1)`` candidates or no list is left. Within each probed list the candidates' vectors, rotated
by a random orthogonal matrix, are read in blocks of columns. After each block a hypothesis test on the partial distance abandons a
candidate that is most likely farther than the k-th best so far. What survives is measured on the original vectors in double
precision.

Lists are cut into parts of at most about ``part_rows`` candidates and the queries of a list into parts of ``part_queries``,
so no task holds a whole list. Equal vectors need no part of their own: of each only the ``k + 1`` smallest ids can be
wanted, and equal queries are searched once.

Defined results: vectors that are null, zero, of another length than the most frequent one of the sample, or holding null or
non-finite components take no part, neither as query nor as candidate. A row repeated with the same id and vector counts once;
an id with several vectors counts with its nearest as a candidate, and as a query with the smallest distance of any of them.
Ties go to the smaller id. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutascale.llm.texts import splittable, stored

RESULT = "rep long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """True for a vector of finite components that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN sorts above infinity
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Centres, rotation and the number of lists to probe; fitted on at most ``sample_rows`` vectors."""

    def __init__(self, sample: np.ndarray, total: int, k: int, recall: float, max_lists: int, seed: int):
        rng = np.random.default_rng(seed)
        n, self.dim = sample.shape
        lists = max(1, min(int(total**0.5), max_lists, n // 8))
        self.centres = sample[rng.choice(n, lists, replace=False)].copy()
        for _ in range(10):
            at = self.lists_of(sample, 1)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, at, sample)
            sizes = np.bincount(at, minlength=lists)
            self.centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centres)
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        self.probes = self._probes(sample, k, recall, rng)

    def lists_of(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The nearest ``probes`` lists of each vector, nearest first."""
        far = (self.centres**2).sum(1) - 2 * vectors @ self.centres.T
        if probes == 1:
            return far.argmin(1)[:, None]
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def probed(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each vector probes: the nearest ``probes``, and further ones until they hold ``least`` candidates."""
        out = []
        for at in range(0, len(vectors), 1024):
            order = self.lists_of(vectors[at : at + 1024], len(self.centres)).astype(np.int32)
            wanted = np.maximum((np.cumsum(sizes[order], axis=1) < least).sum(1) + 1, self.probes)
            out += [row[:n] for row, n in zip(order, wanted)]
        return out

    def _probes(self, sample: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
        """Lists to probe so that the share of a sample query's true neighbours in them reaches ``recall``."""
        asked = rng.choice(len(sample), min(len(sample), 256), replace=False)
        far = (sample**2).sum(1) - 2 * sample[asked] @ sample.T
        far[np.arange(len(asked)), asked] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
        order = self.lists_of(sample[asked], len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        found = np.take_along_axis(place, self.lists_of(sample, 1)[:, 0][near], axis=1).ravel()
        return int(np.quantile(found, recall, method="higher")) + 1


def scan(
    queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, block: int, eps: float
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact distances of its ``k`` nearest candidates that survive the tests."""
    dim = vectors.shape[1]
    turned, asked = vectors @ rotation, queries @ rotation
    cuts = list(range(0, dim, block)) + [dim]
    out = []
    for query, turned_query in zip(queries, asked):
        alive = np.arange(len(ids))
        partial = np.zeros(len(ids))
        limit, held = np.inf, np.zeros(len(ids), bool)
        for lo, hi in zip(cuts, cuts[1:]):
            partial = partial + ((turned[alive, lo:hi] - turned_query[lo:hi]) ** 2).sum(1)
            if lo == 0 and len(alive) > k:
                # the k best after the first block give a bound that no later k-th best exceeds
                first = alive[np.argpartition(partial, k - 1)[:k]]
                limit = ((turned[first] - turned_query) ** 2).sum(1).max() * (1 + 1e-9)
                held[first] = True  # never abandoned, so k are always left
            if hi < dim:
                near = (partial * (dim / hi) <= limit * (1 + eps / np.sqrt(hi)) ** 2) | held[alive]
                alive, partial = alive[near], partial[near]
        exact = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
        best = np.lexsort((ids[alive], exact))[:k]
        out.append((ids[alive][best], exact[best]))
    return out


def _search(rotation, k: int, block: int, eps: float) -> Callable:
    def run(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"rep": [], "vec_id": [], "score": []}).astype({"rep": "int64", "vec_id": "int64"})
        ids = candidates["vec_id"].to_numpy()
        # an id may come with several vectors: as many more places as rows that repeat an id
        places = k + len(ids) - len(np.unique(ids))
        found = scan(
            np.stack(queries["vector"]).astype(float), ids, np.stack(candidates["vector"]).astype(float), rotation.value, places,
            block, eps,
        )
        return pd.DataFrame({
            "rep": np.repeat(queries["vec_id"].to_numpy(), [len(i) for i, _ in found]),
            "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found]),
        })

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = 20_000, recall: float = 0.97, max_lists: int = 1024, part_rows: int = 4096,
    part_queries: int = 1024, block: int = 16, eps: float = 2.1, seed: int = 7, enough: int = 4,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other vectors of each query row by Euclidean distance.

    ``is_query`` is a condition on ``id_col``. ``sample_rows`` bounds what the index is fitted on (a hash sample) and
    ``recall`` is the share of neighbours that the probed lists of that sample must hold. The lists that a query probes hold
    at least ``enough * (k + 1)`` candidates, or all.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest; cut before the shuffle and after it
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    kept = base.dropDuplicates(["vector", "vec_id"]).withColumn("place", F.row_number().over(smallest))
    kept = stored(kept.filter(F.col("place") <= k + 1).drop("place"), "vectors")
    total = kept.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    share = int(min(1.0, sample_rows / total) * (1 << 30))
    rows = kept.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share).limit(2 * sample_rows)
    rows = rows.orderBy("vec_id").select("vector").collect() or kept.limit(1).select("vector").collect()
    lengths = np.bincount([len(r["vector"]) for r in rows])
    dim = int(lengths.argmax())
    sample = np.array([r["vector"] for r in rows if len(r["vector"]) == dim])
    index = Index(sample, total, k, recall, max_lists, seed)
    fitted, rotation = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(index.rotation)
    kept = kept.filter(F.size("vector") == dim)

    @F.pandas_udf("array<int>")
    def own_list(batch: pd.Series) -> pd.Series:
        return pd.Series(list(fitted.value.lists_of(np.stack(batch), 1).astype(np.int32)))

    candidates = stored(kept.select("vec_id", "vector", own_list("vector")[0].alias("list")), "lists")
    held = np.zeros(len(index.centres), np.int64)
    for row in candidates.groupBy("list").count().collect():  # one row a list
        held[row["list"]] = row["count"]
    counted = spark.sparkContext.broadcast(held)

    @F.pandas_udf("array<int>")
    def probed(batch: pd.Series) -> pd.Series:
        return pd.Series(fitted.value.probed(np.stack(batch), counted.value, enough * (k + 1)))

    # queries: all rows that ask, each standing for those with its vector
    asking = base.filter(is_query & (F.size("vector") == dim)).dropDuplicates(["vector", "vec_id"])
    reps = asking.groupBy("vector").agg(F.min("vec_id").alias("rep"))
    classes = stored(asking.join(splittable(reps), "vector").select("vec_id", "rep"), "query-classes")
    asked = reps.select(F.col("rep").alias("vec_id"), "vector", F.explode(probed("vector")).alias("list"))
    asked = stored(asked, "probes")

    # parts of each list and of its queries; the counts have one row per list
    sizes = candidates.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    loads = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_queries).cast("int").alias("chunks"))
    plan = F.broadcast(sizes.join(loads, "list"))  # at most max_lists rows
    part = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    left = asked.join(plan, "list").withColumn("chunk", part(F.col("chunks"))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    right = candidates.join(plan, "list").withColumn("part", part(F.col("parts"))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    keys = ["list", "part", "chunk"]
    found = left.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(
        right.select(*keys, "vec_id", "vector").groupBy(*keys)
    ).applyInPandas(_search(rotation, k + 1, block, eps), RESULT)
    best = Window.partitionBy("rep").orderBy("score", "vec_id")
    found = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score"))  # the nearest vector of an id
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    pairs = classes.select(F.col("vec_id").alias("query_id"), "rep").join(found.select("rep", "vec_id", "score"), "rep")
    pairs = pairs.filter(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
