"""Quality classifier by hierarchical empirical Bayes.

A logistic model of style features gives each document evidence. The documents of a host, and of a path below it, share a
prior: the mean evidence of a group is shrunk towards its parent's (path to host, host to all), the more the fewer documents
it has. How strongly is estimated from the spread between groups (method of moments), in grouped aggregates. The posterior
of a document combines its own evidence with the shrunk rate of its path.

The host is the source of a document and the path its language, as the table holds no URL.

Defined results: an empty or null text has features of zero and is judged like any other. A null host or path is a group of
its own. Without usable labels (none, or of one class) the model is the share of good labels with one count added to each class, whatever the
text. Repeated rows are judged each; repeated labels count each. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.llm.texts import stored, word_list

FEATURES = [
    "symbols", "marks", "bars", "upper", "digits", "length", "short", "repeated_words", "repeated_lines", "word_length",
    "ends", "long_words",
]


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, host, path``, the columns ``carry`` and the style features of every document, in built-in functions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"), *carry,
    ).withColumns({"words": word_list(F.col("text")), "lines": F.split(text, "\\n", -1)})
    n, chars = F.greatest(F.size("words"), F.lit(1)), F.greatest(F.length(text), F.lit(1))

    def count(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")

    return base.select(
        "doc_id", "host", "path", *carry,
        (count("#*$%&<>@~^=") / n).alias("symbols"), (count("!?") / n).alias("marks"), (count("|") / n).alias("bars"),
        (count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars).alias("upper"), (count("0123456789") / chars).alias("digits"),
        F.log1p(F.size("words").cast("double")).alias("length"), (F.size("words") < 20).cast("double").alias("short"),
        (1 - F.size(F.array_distinct("words")) / n).alias("repeated_words"),
        (1 - F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1))).alias("repeated_lines"),
        (F.length(text) / n / 10).alias("word_length"), (count(".") / n).alias("ends"),
        (F.size(F.filter("words", lambda w: F.length(w) > 20)) / n).alias("long_words"),
    )


def evidence(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """Adds ``evidence``, the log odds of good quality by the document's own features.

    The model is fitted on a hash sample of about ``max_rows`` labelled rows.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    known = known.filter(F.col("label").isin(0.0, 1.0))
    n = known.count()
    share = int(min(1.0, max_rows / n) * (1 << 30)) if n else 0
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    train = stored(rows.join(known, "doc_id").select(*FEATURES, "label"), "train")
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    good, bad = seen.get(1.0, 0), seen.get(0.0, 0)
    if not good or not bad:
        return rows.withColumn("evidence", F.lit(log((good + 1) / (bad + 1))))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembler.transform(train))
    model = LogisticRegression(maxIter=60, regParam=1e-4, standardization=False).fit(
        scaler.transform(assembler.transform(train))
    )
    # the scaled model as one expression over the columns
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    slope = [w / s if s > 0 else 0.0 for w, s in zip(model.coefficients.toArray(), std)]
    start = float(model.intercept - sum(w * m for w, m in zip(slope, mean)))
    return rows.withColumn("evidence", sum((F.col(c) * float(w) for c, w in zip(FEATURES, slope)), F.lit(start)))


def _shrunk(groups: DataFrame, parent: Column) -> DataFrame:
    """Adds ``rate``: the mean of each group drawn towards ``parent``, by a strength estimated over all groups."""
    mean = F.col("x") / F.col("n")
    row = groups.select(
        "n", (F.col("n") * F.pow(mean - parent, 2)).alias("d"),
        (parent * (1 - parent)).alias("v"),
    ).agg(F.sum("d"), F.sum("v"), F.sum("n"), F.avg("v")).first()
    spread, noise, n, v = (x or 0.0 for x in row)
    # squared deviations beyond what independent documents of the parent's rate would give
    between = max((spread - noise) / n, 1e-6) if n else 1e-6
    strength = min(max(v / between - 1, 1.0), 1e6)
    return groups.withColumn("rate", (F.col("x") + strength * parent) / (F.col("n") + strength))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, max_rows: int = 50_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, posterior, kept`` of every row, and its columns ``carry``.

    ``max_rows`` bounds what is fitted.
    """
    rows = stored(features(docs, id_col, text_col, host_col, path_col, carry), "features")
    rows = evidence(rows, labels, id_col, label_col, max_rows)
    rows = stored(rows.select("doc_id", "host", "path", "evidence", *carry), "evidence")
    own = 1 / (1 + F.exp(-F.col("evidence")))
    paths = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("x")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    x, n = hosts.agg(F.sum("x"), F.sum("n")).first()
    overall = (x + 0.5) / (n + 1) if n else 0.5
    hosts = _shrunk(hosts, F.lit(overall)).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    paths = _shrunk(paths, F.col("host_rate")).select(
        F.col("host").alias("h"), F.col("path").alias("p"), "host_rate", F.col("rate").alias("path_rate")
    )
    out = rows.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    # the model's own prior is the overall rate; the path's takes its place
    odds = F.col("evidence") + F.ln(F.col("path_rate") / (1 - F.col("path_rate"))) - log(overall / (1 - overall))
    posterior = 1 / (1 + F.exp(-odds))
    return out.select(
        F.col("doc_id").alias(id_col), "evidence", "host_rate", "path_rate", posterior.alias("posterior"),
        (posterior >= threshold).alias("kept"), *carry,
    )
