"""Correlations and variance inflation from one distributed pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import quoted

PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each pair of features as rows (f1, f2, r) with f1 after f2 in the list.

    Numbers and booleans; a pair uses the rows where both are known; a feature that is constant there gives null.
    """
    values = [quoted(name).cast("double") for name in features]
    centre = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    sums = _pair_sums(df, values, [m or 0.0 for m in centre]).where("i > j")
    n = F.col("n")
    spread = {}
    for x in "xy":
        about = F.col(f"s{x}{x}") - F.try_divide(F.col(f"s{x}") * F.col(f"s{x}"), n)
        # what rounding leaves of a constant is no spread
        spread[x] = F.when(about > F.col(f"s{x}{x}") * 1e-13, about)
    both = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    named = F.array(*map(F.lit, features))
    return sums.select(
        F.element_at(named, F.col("i") + 1).alias("f1"), F.element_at(named, F.col("j") + 1).alias("f2"),
        (both / F.sqrt(spread["x"] * spread["y"])).alias("r"),
    )


def variance_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation factor of each feature against the others, without an intercept column.

    Only rows where every number is known count; an unknown boolean is false. Only the k x k matrix of cross products leaves
    the executors. A feature that the others determine gives infinity, one that is zero throughout null.
    """
    values = [_number(df, name) for name in features]
    whole = df.where(reduce(and_, [v.isNotNull() for v in values]))
    gram = np.zeros((len(features), len(features)))
    for row in _pair_sums(whole, values, [0.0] * len(features)).collect():
        gram[row["i"], row["j"]] = gram[row["j"], row["i"]] = row["sxy"]
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    scaled = gram / np.outer(scale, scale)
    rows = []
    for i, name in enumerate(features):
        if gram[i, i] == 0:
            rows.append((name, None))
            continue
        others = [j for j in range(len(features)) if j != i]
        block, cross = scaled[np.ix_(others, others)], scaled[others, i]
        left = 1.0 - cross @ np.linalg.pinv(block, rcond=1e-10, hermitian=True) @ cross
        rows.append((name, float("inf") if left < 1e-12 else float(1.0 / left)))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def _number(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() == "boolean":
        return F.coalesce(quoted(name).cast("double"), F.lit(0.0))
    return quoted(name).cast("double")


def _pair_sums(df: DataFrame, values: list[Column], centre: list[float]) -> DataFrame:
    """For each pair of values i >= j, over the rows where both are known: count, sums, squares and product about the centres.

    One pass: a task multiplies the matrices of its Arrow batches and hands on one row per pair.
    """
    low = np.tril_indices(len(values))
    about = np.array(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(low[0])))
        for batch in batches:
            x = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            known = ~np.isnan(x)
            x, w = np.where(known, x - about, 0.0), known.astype(float)
            sums, squares = x.T @ w, (x * x).T @ w
            total += np.stack([m[low] for m in (w.T @ w, sums, sums.T, squares, squares.T, x.T @ x)])
        columns = [pa.array(place, pa.int32()) for place in low] + [pa.array(row) for row in total]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *PAIR_SUMS])

    schema = "i int, j int, " + ", ".join(f"{name} double" for name in PAIR_SUMS)
    parts = df.select(*[v.alias(f"v{k}") for k, v in enumerate(values)]).mapInArrow(run, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in PAIR_SUMS])
