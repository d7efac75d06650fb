"""Temperature mixing of sources, realised as budgeted permutations of blocks.

Source weights are the token shares raised to an exponent and normalised. The exponent lies between 0 (all sources alike) and
1 (as they are). It is the smallest that keeps the entropy of the weights at or below ``target_entropy`` (a share of the
entropy of equal weights) and every source within ``max_epochs`` passes. Both fall as it grows, so it is found by bisection;
each round tries several exponents at once, in one aggregate over the table of sources, which never leaves Spark.

A source gets ``round(weight * budget)`` tokens: whole passes over all its documents, then a part of one more. Documents are
dealt into blocks by a hash, blocks of a pass are permuted by another, documents within a block by a third. In the last pass
the blocks that fit are taken whole, and the block at the limit gives documents in their order while they fit. So only sums
per block are ordered, never the documents of a source, and a source with a third of all rows is spread over its blocks.

Defined results: the tokens of a document are its words; a text that is null, empty or of white space has none and is returned once (in pass
0). A null source is a source. Repeated rows are documents each. An empty table, or one without tokens, gives each row once.
Only the named columns are read; all columns are returned. The table's columns may have any name: inside they are numbered,
and one that is named like a column of the result gives way to it.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutascale.llm.texts import stored, word_list

STEPS, ROUNDS = 32, 6
OUT = ("mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_order")


def _hash(*parts: Column | str) -> Column:
    """A non-negative 60-bit number from the text of the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _turn(seed: int, *parts: Column) -> Column:
    """Place in the permutation of a pass."""
    return _hash(F.lit(seed + 1), *parts)


def exponent(sources: DataFrame, target_entropy: float, max_epochs: float) -> float:
    """The smallest exponent that meets both limits; 1 if none below does."""
    total, k = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not k:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)]
        powers = sources.select(share.alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("x"))
        power = F.pow("p", "x")
        sums = powers.groupBy("x").agg(
            F.sum(power).alias("z"), F.sum(power * F.ln("p") * F.col("x")).alias("e"), F.max(power / F.col("p")).alias("r")
        )
        # entropy of w = p^x / z, and the passes of the source that is repeated most when the budget is the whole corpus
        rows = sums.select("x", (F.ln("z") - F.col("e") / F.col("z")).alias("h"), (F.col("r") / F.col("z")).alias("r")).collect()
        most = target_entropy * log(k)
        met = [r["x"] for r in rows if r["h"] <= most + 1e-12 and r["r"] <= max_epochs + 1e-12]
        hi = min(met, default=1.0)
        lo = max([x for x in grid if x < hi], default=0.0)
        if hi == 0.0:
            break
    return hi


def mix_sources(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    target_entropy: float = 0.97, max_epochs: float = 4.0, budget: float = 1.0, block_tokens: int = 1_000_000, seed: int = 11,
) -> DataFrame:
    """Every drawn document with its columns and ``mix_tokens, mix_weight, mix_pass, mix_block, mix_order``.

    ``budget`` is in multiples of the corpus. Sorting by ``mix_pass, mix_block, mix_order`` gives the training order.
    ``target_entropy`` is a share of the entropy of equal weights.
    """
    base = docs.select(
        *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)),
        F.size(word_list(F.col(text_col))).cast("long").alias("mix_tokens"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("mix_source"),
        _hash(F.lit(seed), F.col(id_col), F.col(text_col)).alias("mix_key"),
    )
    slim = stored(base.select("mix_source", "mix_tokens", "mix_key"), "tokens")
    sources = stored(slim.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens")).filter("tokens > 0"), "sources")
    x = exponent(sources, target_entropy, max_epochs)
    power = F.pow(F.col("tokens").cast("double"), F.lit(x))
    total, norm = sources.agg(F.sum("tokens"), F.sum(power)).first()
    weight = power / F.lit(norm or 1.0)
    quota = F.round(weight * F.lit(float((total or 0) * budget))).cast("long")
    plan = sources.select("mix_source", "tokens", weight.alias("mix_weight"), quota.alias("quota"))
    plan = stored(plan.select(
        "mix_source", "mix_weight", F.floor(F.col("quota") / F.col("tokens")).alias("passes"),
        F.pmod("quota", "tokens").alias("rest"), F.ceil(F.col("tokens") / block_tokens).alias("blocks"),
    ), "plan")

    # the last, partial pass: running sums over blocks, then over the documents of the one block at the limit
    own = F.pmod("mix_key", "blocks").alias("mix_cell")
    dealt = slim.filter("mix_tokens > 0").join(plan, "mix_source").select("*", own)
    cells = dealt.groupBy("mix_source", "mix_cell", "passes", "rest").agg(F.sum("mix_tokens").alias("cell_tokens"))
    turn = Window.partitionBy("mix_source").orderBy(_turn(seed, F.col("passes"), F.col("mix_source"), F.col("mix_cell")), "mix_cell")
    cells = cells.withColumn("upto", F.sum("cell_tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    cells = stored(cells.withColumn("before", F.col("upto") - F.col("cell_tokens")).filter("before < rest"), "cells")
    edge = cells.filter("upto > rest").select("mix_source", "mix_cell", "before")
    edge = dealt.join(edge, ["mix_source", "mix_cell"])
    place = Window.partitionBy("mix_source").orderBy(_turn(seed, F.col("passes"), F.col("mix_key")), "mix_key")
    edge = edge.withColumn("used", F.sum("mix_tokens").over(place.rangeBetween(Window.unboundedPreceding, 0)))
    last = edge.filter("before + used <= rest").groupBy("mix_source").agg(
        F.max(F.struct(_turn(seed, F.col("passes"), F.col("mix_key")).alias("t"), F.col("mix_key").alias("k"))).alias("upto_key")
    )
    taken = cells.select("mix_source", "mix_cell", (F.col("upto") <= F.col("rest")).alias("whole")).join(last, "mix_source", "left")

    # the documents: whole passes, and the last pass where their block or their place in it is within the limit
    drawn = base.join(plan, "mix_source", "left")
    drawn = drawn.withColumn("mix_cell", F.pmod("mix_key", F.coalesce("blocks", F.lit(1)))).join(
        taken, ["mix_source", "mix_cell"], "left"
    )
    key = F.struct(_turn(seed, F.col("passes"), F.col("mix_key")).alias("t"), F.col("mix_key").alias("k"))
    more = F.coalesce(F.col("whole") | (F.col("upto_key").isNotNull() & (key <= F.col("upto_key"))), F.lit(False))
    count = F.when(F.col("mix_tokens") == 0, F.lit(1)).otherwise(F.col("passes") + more.cast("long"))
    drawn = drawn.withColumn("copies", count).filter(F.col("copies") > 0)
    drawn = drawn.withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    block = _turn(seed, F.col("mix_pass"), F.col("mix_source"), F.col("mix_cell"))
    own = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in OUT]
    return drawn.select(
        *(F.col(f"own_{i}").alias(c) for i, c in own), "mix_tokens", "mix_weight", "mix_pass", block.alias("mix_block"),
        _turn(seed, F.col("mix_pass"), F.col("mix_key")).alias("mix_order"),
    )
