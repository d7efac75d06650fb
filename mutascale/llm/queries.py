"""The registered queries of the subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascale.llm import (
    ann, centroids, chat_tools, collocations, host_rules, licenses, mixing, ngram_join, packing, quality, substring_dedup, toxicity,
    url_filter,
)
from mutascale.llm.texts import read

#: The rule list of the URL filter.
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
TOOLS: chat_tools.Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "write": {"topic": ("string", True), "words": ("integer", True)},
}
TOKENIZER = "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document keeps when passages of 50 words and more that came before are removed."""
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), keep_text=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates (five-word shingles, similarity 0.75) of every document."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from labels whose crc32(doc_id) leaves a remainder by 3 other than 1."""
    return toxicity.score(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), lambda i: F.crc32(i.cast("string")) % 3 != 1
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one corpus-sized draw with tempered source weights, and their places in it."""
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), "mix_pass", "mix_block", "mix_order"
    )


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, base verdict, and the verdict of its host."""
    return host_rules.judge(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document, and whether it is kept."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered and validated tool calls of all conversations (user turns as calls, the answers as results)."""
    return chat_tools.link_calls(chat_tools.calls_of_turns(read(spark, sf_dir, "conversations")), TOOLS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases in every document, and the labels of its phrases and notices."""
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.PHRASES + licenses.NOTICES)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after five rounds with 40 centroids."""
    return centroids.clustered(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of two and three words that hold together best in each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_nearest": op5_nearest,
    "op6_host_rules": op6_host_rules,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_tool_calls": op9_tool_calls,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_centroids": op12_centroids,
    "op13_collocations": op13_collocations,
}
