"""Joining per-key facts back onto rows, and checked lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutascale.functions.scalar import quoted


def attach_by_key(
    rows: DataFrame, profile: DataFrame, keys: list[str], columns: list[str], keep: Column | None = None
) -> DataFrame:
    """Join a per-key aggregate of ``rows`` back onto them.

    ``profile`` has one row for every key. ``keep`` is a condition on it: rows whose key does not satisfy it, or that
    have no key, are dropped. Without it the join is a left join.

    One equi-join: Spark broadcasts the profile while it is below its size threshold, otherwise shuffles both sides
    and splits the partition of a hot key at run time (adaptive skew handling, on in ``session.SETTINGS``). It does so
    only where a shuffle stands right below the join, so the profile is rebalanced after its aggregate.
    """
    if keep is not None:
        profile = profile.where(F.coalesce(keep, F.lit(False)))
    side = profile.select(*[F.col(c).alias(f"__key_{c}") for c in keys], *[F.col(c).alias(f"__of_{c}") for c in columns]).hint("rebalance")
    how = "left" if keep is None else "inner"
    joined = rows.join(side, [F.col(k) == F.col(f"__key_{k}") for k in keys], how)
    return joined.select(*[quoted(c) for c in rows.columns], *[F.col(f"__of_{c}").alias(c) for c in columns])


def keep_keys(rows: DataFrame, profile: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Semi-join: rows whose key's profile satisfies the condition. Rows without a key are dropped."""
    return attach_by_key(rows, profile, keys, [], condition)


def group_count(rows: DataFrame, keys: list[str], name: str = "n", width: int | None = None) -> DataFrame:
    """Number of rows of the key on every row; null for rows without a key.

    With ``width`` the rows are dealt to so many tasks once and counted where they lie, so that what is behind them is
    computed once; for keys that hold a small share of the rows each, since a key is not split then.
    """
    if width is not None:
        known = reduce(and_, [F.col(k).isNotNull() for k in keys])
        counted = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return rows.repartition(width, *keys).withColumn(name, F.when(known, counted))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return attach_by_key(rows, counts, keys, [name])


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that first checks the keys are unique on both sides."""
    for side, df in (("left", left), ("right", right)):
        repeated = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1)
        if not repeated.isEmpty():
            raise ValueError(f"keys {keys} are not unique on the {side} side")
    return left.join(right, keys, "left")


def left_lookup(rows: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left equi-join with a lookup table; Spark broadcasts it only while it is below its own size threshold."""
    return rows.join(lookup.select(key, *columns), key, "left")


def verified_lookup(rows: DataFrame, lookup: DataFrame, digest: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Left lookup by a hash of the row that compares the keys as well: where different keys share a hash, each finds its own.

    ``digest`` and ``keys`` are columns of both sides, the keys compared as text, null equal to null. All comparisons are
    equalities of one join. ``lookup`` holds a key once.
    """
    own = {name: f"__lookup_{i}" for i, name in enumerate([digest, *keys])}
    side = lookup.select(*[quoted(c).cast("string").alias(alias) for c, alias in own.items()], *[quoted(c) for c in columns])
    same = [quoted(c).cast("string").eqNullSafe(F.col(alias)) for c, alias in own.items() if c != digest]
    found = reduce(and_, same, quoted(digest).cast("string") == F.col(own[digest]))
    return rows.join(side, found, "left").drop(*own.values())
