"""Quality rules with host verdicts: rules per document, failure rates per host shrunk by an empirical beta prior.

All of it is DataFrame expressions; no Python runs on the executors.

Defined results: a null or empty text has no words and fails the base rules. A document without a host (null) has no host
verdict and is judged by the base rules alone. Repeated rows count each, as documents of their host, and come back each.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mutascale.llm.texts import WORD_RE, splittable, stored, word_list

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SCALE = 1_000_000


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by a window whose hash occurs at least twice in the array of window hashes."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # neighbours in the sorted array: a window repeats when the one before or after it has its hash
    keys = F.transform(order, lambda s: s["h"])
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(keys, 1, F.size(keys) - 1))
    after = F.concat(F.slice(keys, 2, F.size(keys)), F.array(F.lit(None).cast("long")))
    marked = F.transform(
        F.arrays_zip(order.alias("s"), before.alias("b"), after.alias("a")),
        lambda z: F.when(z["s"]["h"].eqNullSafe(z["b"]) | z["s"]["h"].eqNullSafe(z["a"]), z["s"]["i"]),
    )
    starts = F.sort_array(F.array_compact(marked))
    gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: b - a)
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda acc, gap: acc + F.least(gap, F.lit(WINDOW)))
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(covered)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host`` and the counts of the base rules of every document.

    Windows of eight words are told apart within one text by a 64-bit hash of the hashes of their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    base = base.withColumns({
        "words": F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size("words")
    hashes = F.when(
        n > WINDOW,
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))
        ),
    ).otherwise(F.array().cast("array<long>"))
    base = base.select(
        "doc_id", "host", n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words", hashes.alias("hashes"),
    )
    repeats = F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(
        _repeat_words(F.col("words"), F.col("hashes"))
    )
    return base.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words")
    )


def _beta_prior(totals: Row) -> tuple[float, float]:
    """Mean and strength by the method of moments: between-host variance is the weighted squared deviation less binomial noise.

    The sums are exact, so the prior does not depend on the order in which hosts were added.
    """
    n, x, nn, k = (float(totals[c] or 0) for c in ("N", "X", "nn", "k"))
    mean = (x + 0.5) / (n + 1.0)
    noise = mean * (1 - mean)
    scale = n - nn / n if n else 0.0
    between = noise / 10000.0
    if scale > 0:
        between = max((float(totals["xx"]) / SCALE - x * x / n - (k - 1) * noise) / scale, between)
    return mean, max(noise / min(between, noise * 0.5) - 1, 1.0)


def host_verdicts(judged: DataFrame, max_rate: float, z: float) -> DataFrame:
    """``host, host_docs, host_rate, host_bad`` from one row per document with ``host`` and ``base_failed``.

    The prior is the beta distribution whose mean and variance match the rates of the hosts (method of moments, hosts
    weighted by their documents). A host is bad when its shrunk rate, less ``z`` posterior deviations, is above
    ``max_rate``. Documents are summed before the shuffle, so a host with a third of all rows is no hot key.
    """
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("x")
    )
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    totals = hosts.agg(
        F.sum("n").alias("N"), F.sum("x").alias("X"), F.count(F.lit(1)).alias("k"),
        # of each host's x * x / n the integer part of its millionfold, so the sum is one of integers
        F.sum(F.call_function("div", wide("x") * wide("x") * F.lit(SCALE), wide("n")).cast("decimal(38,0)")).alias("xx"),
        F.sum((wide("n") * wide("n")).cast("decimal(38,0)")).alias("nn"),
    )
    mean, strength = _beta_prior(totals.first())  # one row, whatever the number of hosts
    total = F.col("n") + strength
    rate = (F.col("x") + mean * strength) / total
    low = rate - z * F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.select("host", F.col("n").alias("host_docs"), rate.alias("host_rate"), (low > max_rate).alias("host_bad"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_rate: float = 0.5, z: float = 2.0,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, the host's shrunk failure rate and ``kept``."""
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    judged = rule_counts(docs, id_col, text_col, host_col).withColumn("base_failed", (n < 20) | (100 * repeats > 30 * n))
    judged = stored(judged, "rule-counts")  # read twice: for the hosts and for the documents
    hosts = host_verdicts(judged, max_rate, z)
    out = judged.join(splittable(hosts), "host", "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_bad"), F.lit(False))
    )
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "host", "host_docs", "host_rate",
    )
