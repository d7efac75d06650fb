"""Phrase collocations from stripes: each prefix keys an associative counter of the words that follow it.

Texts are cut into pieces at punctuation and line ends, and pieces into words. For phrases of m words, the stripe of a prefix
of m - 1 words counts the word after each of its occurrences, and how often it ends a piece. Stripes answer three questions:

* extensions: an entry of a stripe is the frequency of prefix + word,
* prefix totals: a stripe's sum, with the ends of pieces, is the frequency of the prefix (one-word stripes: of each word);
  it is kept as an entry of the stripe,
* subsumption maxima: the largest entry that holds a phrase is its most frequent extension on the right as a prefix, and on
  the left as the end of an entry.

Tasks gather stripes in memory, ``held`` entries at a time, and emit them cut into buckets by prefix and next word. A bucket
holds a part of many stripes, and a hot prefix is spread over ``SLICES`` of them, so no key holds a stripe as a whole. Stripes
of a bucket are merged elementwise by an aggregate that may spill. Only sums and extensions of ``min_count`` are kept.

Longer phrases are built level by level: a phrase can reach ``min_count`` only if the phrases without its last and without its
first word do. Their 64-bit hashes set bits of a bitmap (``BITS_PER_PHRASE`` bits each, at most ``MAX_BITS``), which tells a
task what it need not count. A bit that is set by chance only costs a counter; above ``MAX_BITS`` more of them are, and no
result changes. All counts are by the words themselves.

Defined results: a null text is empty, a text without words has no phrases. A null language is ``und`` (as is the language of
that name). Repeated rows, and rows without an id, count each. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.operators.sampling import with_ordinal
from mutascale.llm.texts import mix, raw_texts, splittable, stored, window_hashes, word_bounds, word_hashes

#: A-Z in lower case; what ends a piece becomes a line feed.
_TABLE = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[ \t\n]")
#: Stands for the end of a piece; no word has this character.
END = b"."
SLICES = 8
BITS_PER_PHRASE = 16
MAX_BITS = 1 << 28


def _portions(raw: bytes, size: int, most: int = 1 << 20) -> Iterator[tuple[bytes, bool]]:
    """A text in portions of about ``most`` bytes, and whether a portion ends with a piece.

    A piece longer than that is cut between words, and its next portion begins with the last ``size - 1`` words again: so each
    run of ``size`` words lies in one portion.
    """
    at, carry = 0, b""
    while len(raw) - at > most:
        cut, ends = raw.rfind(b"\n", at, at + most), True
        if cut < 0:
            cut, ends = max(raw.rfind(b" ", at, at + most), raw.rfind(b"\t", at, at + most)), False
        if cut < 0:  # a word longer than a portion
            gap = _GAP.search(raw, at + most)
            if gap is None:
                break
            cut, ends = gap.start(), raw[gap.start()] == 10
        portion = carry + raw[at:cut]
        yield portion, ends
        carry = b"" if ends else b" ".join(portion.rsplit(None, size - 1)[1 - size :]) + b" "
        at = cut + 1
    yield carry + raw[at:], True


def _language_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _may_be_frequent(raw: bytes, size: int, bits: np.ndarray, seed: np.uint64) -> Iterator[tuple[bytes, ...]]:
    """The runs of ``size`` words in the pieces whose two parts of ``size - 1`` words have their bits set."""
    hashes = word_hashes(raw)
    part = window_hashes(hashes, size - 1)
    if len(part) < 2:
        return
    slots = (mix(part ^ seed) % np.uint64(len(bits) * 8)).astype(np.int64)
    hit = bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1
    starts, _ = word_bounds(raw)
    piece = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), starts)
    whole = piece[size - 1 :] == piece[: len(piece) - size + 1]
    places = np.flatnonzero(hit[:-1] & hit[1:] & whole)
    if len(places):
        words = raw.split()
        for at in places.tolist():
            yield tuple(words[at : at + size])


def _gather(size: int, bits, buckets: int, held: int) -> Callable:
    """Stripes of the prefixes of ``size - 1`` words, cut into buckets. Without ``bits``, of all one-word prefixes, and with a
    last entry for the stripe's sum, whose word is empty."""
    texts = pa.list_(pa.string())
    schema = pa.schema([
        ("lang", pa.string()), ("bucket", pa.int32()), ("prefix", texts), ("next", texts), ("count", pa.list_(pa.int64())),
    ])

    def emit(lang: str, counts: Counter) -> pa.RecordBatch:
        counts = {words: count for words, count in counts.items() if words[0] != END}
        prefixes = [b" ".join(words[:-1]) for words in counts] if size > 2 else [words[0] for words in counts]
        words, numbers = [words[-1] for words in counts], list(counts.values())
        if bits is None:
            totals: dict[bytes, int] = {}
            for prefix, number in zip(prefixes, numbers):
                totals[prefix] = totals.get(prefix, 0) + number
            prefixes += totals
            words += [b""] * len(totals)
            numbers += totals.values()
        # a stripe is spread over SLICES buckets by the next word
        crc = zlib.crc32
        bucket = np.fromiter(map(crc, prefixes), np.int64, len(prefixes)) * SLICES
        bucket = (bucket + np.fromiter(map(crc, words), np.int64, len(words)) % SLICES) % buckets
        order = np.argsort(bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        offsets, order = pa.array([*first.tolist(), len(order)], pa.int32()), pa.array(order)
        columns = [pa.array(prefixes, pa.binary()).cast(pa.string()), pa.array(words, pa.binary()).cast(pa.string())]
        lists = [pa.ListArray.from_arrays(offsets, c.take(order)) for c in (*columns, pa.array(numbers, pa.int64()))]
        langs = pa.array([lang] * len(present), pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array(present, pa.int32()), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, Counter] = {}
        known = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        entries = 0
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                if not raw:
                    continue
                seed = _language_seed(lang)
                for portion, ends in _portions(raw.translate(_TABLE), size):
                    counts = stripes.setdefault(lang, Counter())
                    before = len(counts)
                    if known is not None:
                        counts.update(_may_be_frequent(portion, size, known, seed))
                    else:
                        tokens = portion.replace(b"\n", b" . ").split()
                        if ends:
                            tokens.append(END)
                        counts.update(zip(tokens, tokens[1:]))
                    entries += len(counts) - before
                    if entries > held:
                        yield from (emit(name, own) for name, own in stripes.items() if own)
                        stripes, entries = {}, 0
        yield from (emit(name, own) for name, own in stripes.items() if own)

    return run


def _merged(docs: DataFrame, size: int, bits, min_count: int, held: int) -> DataFrame:
    """Merged stripes as ``lang, prefix, next, count``: sums (where ``next`` is empty) and extensions of ``min_count`` and more.

    The elementwise merge runs where the buckets are.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = docs.mapInArrow(
        _gather(size, bits, max(1024, 8 * partitions), held),
        "lang string, bucket int, prefix array<string>, next array<string>, count array<long>",
    )
    entries = gathered.repartition("lang", "bucket").select(
        "lang", "bucket", F.inline(F.arrays_zip("prefix", "next", "count"))
    )
    merged = entries.groupBy("lang", "bucket", "prefix", "next").agg(F.sum("count").alias("count")).drop("bucket")
    return merged.filter((F.col("next") == "") | ((F.col("count") >= min_count) & (F.col("next") != END.decode())))


def _extensions(stripes: DataFrame) -> DataFrame:
    return stripes.filter("next <> ''").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("count").alias("a"))


def _bitmap(phrases: DataFrame, size: int, count: int) -> bytes:
    """A bit for the hash of each phrase of ``size`` words; its length follows from their number."""
    bits = min(MAX_BITS, max(1 << 15, 1 << (BITS_PER_PHRASE * count - 1).bit_length()))
    schema = pa.schema([("slot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).dictionary_encode(), list(raw_texts(batch.column(1)))
            if phrases:
                seeds = np.array([_language_seed(lang) for lang in langs.dictionary.to_pylist()])
                part = window_hashes(word_hashes(b"\n".join(phrases)), size)[::size]  # each phrase has ``size`` words
                slots = mix(part ^ seeds[langs.indices.to_numpy()]) % np.uint64(bits)
                # Spark numbers the buckets of positive values from 1
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64) + 1)], schema=schema)

    parts = phrases.select("lang", "phrase").mapInArrow(run, "slot long").groupBy(
        F.bitmap_bucket_number("slot").alias("b")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    out = bytearray(bits // 8)
    for row in parts.toLocalIterator():  # at most MAX_BITS / 32768 rows of 4 KB
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = row["m"]
    return bytes(out)


def frequencies(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", held: int = 800_000,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, a`` of all words, and ``lang, phrase, a, m`` of the phrases of 2 to ``max_words`` words that occur
    ``min_count`` times and more."""
    spark = docs.sparkSession
    docs = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    ).filter("text IS NOT NULL")
    stripes = stored(_merged(docs, 2, None, min_count, held), "stripes")
    words = stripes.filter("next = ''").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("count").alias("a"))
    levels = [stored(_extensions(stripes), "phrases-2")]
    for size in range(3, max_words + 1):
        count = levels[-1].count()
        if not count:
            break
        bits = spark.sparkContext.broadcast(_bitmap(levels[-1], size - 1, count))
        levels.append(stored(_extensions(_merged(docs, size, bits, min_count, held)), f"phrases-{size}"))
        bits.unpersist()
    phrases = levels[0].withColumn("m", F.lit(2))
    for size, level in enumerate(levels[1:], 3):
        phrases = phrases.unionByName(level.withColumn("m", F.lit(size)))
    return words, phrases


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimal integers."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, subsumed_percent: int = 50, top: int = 2000,
    text_col: str = "text", lang_col: str = "lang", held: int = 800_000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the two parts of the cut with the lowest score, ``n`` the words of
    the language. A phrase goes if a longer one that holds it has ``subsumed_percent`` of its frequency. Frequencies stay
    exact below 10**15.
    """
    words, phrases = frequencies(docs, max_words, min_count, text_col, lang_col, held)
    every = words.filter(F.col("a") >= min_count).unionByName(phrases.drop("m"))  # a part is as frequent as the phrase
    parts = F.split("phrase", " ")
    cut = lambda first, n: F.array_join(F.slice(parts, first, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    side = lambda name, f: splittable(every.select("lang", F.col("phrase").alias(name), F.col("a").alias(f)))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r", "a")).alias("s")
    )
    # the largest frequency among the longer phrases that hold a phrase
    inside = phrases.filter("m > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)))
    inside = inside.select("lang", cut(F.col("at"), F.col("k")).alias("phrase"), "a")
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(most, ["lang", "phrase"], "left").select("lang", "phrase", "s.*", "most")
    kept = kept.filter(F.col("most").isNull() | (100 * F.col("most") < subsumed_percent * F.col("a")))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))

    # ranks by one range sort of all languages, so a large language covers several tasks
    kept = kept.select(
        "lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("__score"), (-F.col("a")).alias("__a")
    )
    ranked = with_ordinal(kept, ["lang", "__score", "__a", "phrase"])
    first = ranked.groupBy("lang").agg(F.min("ordinal").alias("first"))
    ranked = ranked.join(first, "lang").withColumn("rank", (F.col("ordinal") - F.col("first") + 1).cast("int"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
