"""The corpus pipeline: documents to packed sequences.

Each stage decides by row. Defined results: a null or empty text is a text without words; the classifier judges it as such,
it is no near-duplicate, loses no passage, is drawn once and is packed as the single end id. Rows without an id pass the
two stages that need an order and are judged, mixed and packed like others. Of rows repeated with one id and text the
near-duplicate stage keeps one. An id with several texts is as many documents. A text of any length is worked through whole.
Extra columns are carried along, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascale.llm import mixing, ngram_join, packing, quality, substring_dedup
from mutascale.llm.queries import TOKENIZER
from mutascale.llm.texts import read, splittable, stored

def fresh(name: str, df: DataFrame) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; a row goes by what its verdict rests on (text, source, language)."""
    number = fresh("verdict", docs)
    parts = [F.col(c).cast("string") for c in ("source", "lang", "text")]
    sizes = [F.coalesce(F.length(p).cast("string"), F.lit("null")) for p in parts]
    row = F.md5(F.concat_ws(" ", *sizes, *(F.coalesce(p, F.lit("")) for p in parts)))
    docs = docs.withColumn(number, row)
    judged = quality.classify(docs, read(spark, sf_dir, "labels"), carry=(number,))
    rejected = splittable(judged.filter(~F.col("kept")).select(number).distinct())
    return docs.join(rejected, number, "left_anti").drop(number)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest id.

    Rows are numbered and go by their own text: another text under the same id has a verdict of its own. Rows without an id
    stay; texts without words are linked with nothing and stay.
    """
    number = fresh("row", docs)
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    known = rows.filter("doc_id IS NOT NULL").select(F.col(number).alias("row"), "doc_id", "text")
    groups = ngram_join.near_duplicates(known, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    linked = groups.join(known.select("row", F.col("doc_id").alias("id")), "row")
    first = linked.groupBy("component_id").agg(F.min_by("row", F.struct("id", "row")).alias("first"), F.count("*").alias("n"))
    gone = linked.join(splittable(first.filter("n > 1")), "component_id").filter("row <> first").select(F.col("row").alias(number))
    return rows.join(splittable(gone), number, "left_anti").drop(number)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that came before; rows that lose all their words go, rows without words stay."""
    cut = substring_dedup.dedup(docs, carry=[c for c in docs.columns if c != "text"]).filter("n_removed = 0 OR n_removed < n_words")
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(columns.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one corpus-sized draw with tempered source weights.

    Columns that are named like one of the operator's own results are put aside under other names for the while.
    """
    aside = {c: fresh(f"own{i}", docs) for i, c in enumerate(docs.columns) if c.lower() in mixing.OUT}
    drawn = mixing.mix_sources(docs.withColumnsRenamed(aside))
    return drawn.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near duplicates", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again as the next one's documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
