"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.llm.texts import discard, splittable, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id that links reach from each linked id.

    Alternating stars: every node first hangs its larger neighbours on the smallest node it knows, then itself and its
    smaller neighbours. Each round at least halves the height of a tree. The minimum per node is summed up before the
    shuffle, and the join that follows may be split by Spark where a node has many neighbours. The table of a round is
    written to the shared folder; only a count and a checksum reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(splittable(root), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(splittable(low), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(small.filter("a <> b").distinct(), "stars")
        discard(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct()
