"""License scans by diagonal voting: texts are aligned with license templates along the diagonals that their k-grams vote for.

A template is a sequence of words with a label and a k-gram length. A k-gram at word p of a text that stands at word t of a
template votes for the diagonal p - t of that template.

1. The rolling k-gram hashes of all words are computed for each k-gram length in use. A hash that no template has cannot be
   joined, so it is left out in the task that computes it; the others keep the words around them (a region: places of
   possible votes that lie within ``reach`` words of one another, with ``reach`` words on both sides).
2. Spark joins the hashes to the template positions and counts the votes by text, template and diagonal.
3. Diagonals that are at most ``slack`` apart are merged, so that words put in or left out do not break a match. Votes are
   summed, and a merged diagonal needs a share ``min_votes`` of its template's k-grams.
4. A merged diagonal is verified on the words: a template word is found if one of the diagonals has it in its place. The span
   counts if a share ``min_similarity`` of the template's words is found.

A phrase is a template whose only k-gram is the whole phrase and which takes no slack: each of its places is one diagonal with
one vote, and it is verified word by word. So phrases are found exactly, and notices may differ in some words.

The templates are a parameter and are broadcast; ``MAX_TEMPLATE_WORDS`` bounds them. Hashes only choose what is compared:
a match rests on equal words, and equal words have equal hashes.

Words are runs of letters and digits of ASCII, A-Z in lower case, and of any other character beyond ASCII.

Defined results: a null or empty text has no words, no places, empty labels and score 0. Repeated rows, and rows without an
id, come back each with their own result. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutascale.llm.texts import raw_texts, splittable, stored, window_hashes, word_hashes

#: Bytes that are no part of a word become a space; A-Z lower case.
_TABLE = bytes(
    b if b > 127 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)
)
MAX_TEMPLATE_WORDS = 1 << 20
_SLOTS = 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    gram: int
    phrase: bool = False


def words_of_text(text: str) -> tuple[str, ...]:
    return tuple(text.encode().translate(_TABLE).decode().split())


def phrase(label: str, text: str) -> Template:
    """Words that must stand consecutively."""
    words = words_of_text(text)
    return Template(label, words, len(words), True)


def notice(label: str, text: str, gram: int = 3) -> Template:
    """A text that may be changed in some words."""
    words = words_of_text(text)
    return Template(label, words, min(gram, len(words)))


def _grams(raw: bytes, gram: int) -> np.ndarray:
    return window_hashes(word_hashes(raw), gram)


def _regions(templates: list[Template], reach: int):
    """A row per text: its words' number, and the regions with their hashes that a template has."""
    known: dict[int, set[int]] = {}
    for t in templates:
        known.setdefault(t.gram, set()).update(_grams(" ".join(t.words).encode(), t.gram).tolist())
    hashes = {gram: np.array(sorted(found), np.uint64) for gram, found in known.items()}
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("regions", REGIONS_ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = {}
        for gram, found in hashes.items():
            slots[gram] = np.zeros(_SLOTS, bool)
            slots[gram][(found % _SLOTS).astype(np.int64)] = True
        for batch in batches:
            rows: list[tuple[int | None, int, list]] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                raw = (raw or b"").translate(_TABLE)
                own = word_hashes(raw)
                hits = []
                for gram, found in hashes.items():
                    grams = window_hashes(own, gram)
                    at = np.flatnonzero(slots[gram][(grams % _SLOTS).astype(np.int64)])
                    at = at[np.isin(grams[at], found)]
                    hits += zip(at.tolist(), [gram] * len(at), grams[at].view(np.int64).tolist())
                rows.append((doc_id, len(own), _cut(raw, sorted(hits), reach) if hits else []))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _cut(raw: bytes, hits: list[tuple[int, int, int]], reach: int) -> list[dict]:
    """The hits in regions, each with the words from ``reach`` before its first to ``reach`` after its last."""
    words, out = raw.split(), []
    for place, gram, value in hits:
        if not out or place - out[-1]["hits"][-1]["place"] > reach:
            out.append({"first": max(0, place - reach), "hits": []})
        out[-1]["hits"].append({"place": place, "gram": gram, "hash": value})
    for region in out:
        region["words"] = words[region["first"] : region["hits"][-1]["place"] + 2 * reach]
    return out


REGIONS = "array<struct<first:int,hits:array<struct<place:int,gram:int,hash:bigint>>,words:array<string>>>"
REGIONS_ARROW = pa.list_(pa.struct([
    ("first", pa.int32()),
    ("hits", pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.int32()), ("hash", pa.int64())]))),
    ("words", pa.list_(pa.string())),
]))


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``gram, hash, template, at``: the k-grams of the templates."""
    rows = [
        (t.gram, value, number, at)
        for number, t in enumerate(templates)
        for at, value in enumerate(_grams(" ".join(t.words).encode(), t.gram).view(np.int64).tolist())
    ]
    return spark.createDataFrame(rows, "gram int, hash long, template int, at int")


def _facts(spark: SparkSession, templates: list[Template], slack: int) -> DataFrame:
    rows = [
        (i, t.label, t.phrase, list(t.words), len(t.words) - t.gram + 1, 0 if t.phrase else slack) for i, t in enumerate(templates)
    ]
    return spark.createDataFrame(
        rows, "template int, label string, phrase boolean, words array<string>, grams int, slack int"
    )


def spans(
    docs: DataFrame, templates: list[Template], slack: int = 3, min_votes: float = 0.3, min_similarity: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All rows as ``row, doc_id, n_words``, and their verified spans: ``row, template, label, phrase, first, last, votes,
    similarity`` (places of the first and the last word, from 0)."""
    if sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words; scan in several calls, spans are independent")
    spark, reach = docs.sparkSession, max(len(t.words) for t in templates) + slack
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = docs.mapInArrow(_regions(templates, reach), f"doc_id long, n_words long, regions {REGIONS}")
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "regions")

    held = scanned.filter(F.size("regions") > 0).select("row", F.posexplode("regions").alias("region", "r"))
    hits = held.select("row", "region", F.explode("r.hits").alias("h")).select("row", "region", "h.*")
    votes = hits.join(F.broadcast(_positions(spark, templates)), ["gram", "hash"])
    votes = votes.groupBy("row", "region", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes")
    )
    # neighbouring diagonals: a new group begins where the step from the one before is too large
    facts = F.broadcast(_facts(spark, templates, slack))
    order = Window.partitionBy("row", "region", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    votes = votes.join(facts.select("template", "slack"), "template")
    votes = votes.withColumn("group", F.sum((F.coalesce(step, F.lit(0)) > F.col("slack")).cast("int")).over(order))
    merged = votes.groupBy("row", "region", "template", "group").agg(
        F.sum("votes").alias("votes"), F.sort_array(F.collect_list("diagonal")).alias("diagonals")
    )
    merged = merged.join(facts, "template").filter(F.col("votes") >= min_votes * F.col("grams"))

    # verification on the words of the region
    regions = held.select("row", "region", F.col("r.first").alias("offset"), F.col("r.words").alias("text"))
    met = splittable(merged).join(regions, ["row", "region"])
    places = F.transform(
        "words",
        lambda w, t: F.array_min(F.filter(
            F.transform("diagonals", lambda d: d + t),
            lambda p: (p >= F.col("offset")) & (F.try_element_at("text", F.greatest(p - F.col("offset") + 1, F.lit(1))) == w),
        )),
    )
    met = met.withColumn("places", F.array_compact(places))
    similarity = F.size("places") / F.size("words")
    verified = met.withColumn("similarity", similarity).filter(F.col("similarity") >= F.when(F.col("phrase"), 1.0).otherwise(min_similarity))
    return scanned.select("row", "doc_id", "n_words"), verified.select(
        "row", "template", "label", "phrase", F.array_min("places").alias("first"), F.array_max("places").alias("last"), "votes",
        "similarity",
    )


def scan(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", **options) -> DataFrame:
    """Every row: ``doc_id, n_words``, the places of phrases (number, first, last), the labels of phrases alone and of all
    verified spans (distinct, sorted, joined by commas), and the largest similarity of a span as ``score``."""
    rows, found = spans(docs, templates, id_col=id_col, **options)
    own = F.col("phrase")
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    # distinct by the phrase's place: two templates of one phrase are one place
    by = found.groupBy("row").agg(
        F.count_distinct(F.when(own, F.struct("first", "last"))).alias("n_base"), F.min(F.when(own, F.col("first"))).alias("first_word"),
        F.max(F.when(own, F.col("first"))).alias("last_word"), labels(F.when(own, F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"), F.max("similarity").alias("score"),
    )
    return rows.join(by, "row", "left").select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


#: The phrases that are looked for, with their labels.
PHRASES = [phrase("mit", "mit license"), phrase("apache", "apache license"), phrase("gpl", "general public license")]

#: The openings of common license notices.
NOTICES = [
    notice("mit", "Released under the MIT License"),
    notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction"),
    notice("apache", "Licensed under the Apache License, Version 2.0"),
    notice("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    notice("gpl", "This work is licensed under the GNU General Public License, version 3"),
    notice("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation"),
    notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                  "that the following conditions are met"),
]
