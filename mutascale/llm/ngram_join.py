"""Near-duplicate join on word shingles by prefix filtering.

A document is the set of its distinct five-word shingles (64-bit hashes). All sets are sorted in one order, rare shingles
first, where rarity is read from a table of counters of fixed size that is filled from the whole corpus; slots that several
shingles share only make the order less sharp, never wrong. Two sets can reach the threshold only if their prefixes in that
order share a shingle.

1. Equal sets become one class, represented by its smallest id.
2. Each prefix shingle links its classes to the smallest of them (a star, not all pairs); these pairs are checked, and the
   links give first components.
3. Only shingles whose classes still lie in several components are joined pairwise, the classes outside the shingle's
   largest component against all others, under the length and positional filters. Pairs within a component need no further link. So the
   components are those of all links, although a group of copies never gives all its pairs. Each row knows the ``BEFORE``
   shingles of this kind that stand before its own in the set; where two sets have one of them in common, they met there
   already and the pair is not listed again.
   Where many classes of a shingle lie outside its largest component, they first meet one drawn member of it for each of
   their shingles, in turns, so members of a large group of near copies that the first hub does not reach are linked by
   a number of pairs in proportion to the rows; the pairwise join is for those that no turn has linked.
4. A pair is checked once: a histogram of the hashes bounds the overlap of the suffixes (the suffix filter), then the sets
   are intersected. Pairs that were checked with a hub are left out of what follows.

Components are found among the classes alone; copies take the component of their class in one join.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with nothing. A null id is
dropped from the links and comes back with a null component. Repeated rows (same id and text) come back each; an id with several texts
takes the links of all of them. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutascale.llm.components import components
from mutascale.llm.texts import discard, raw_texts, small_batches, splittable, stored, window_hashes, word_hashes

SLOTS = 1 << 24
SLOT_BLOCK = 1 << 18
FILTER_BITS = 1 << 24
BINS = 64
BEFORE = 8
#: Shingles that would list more pairs than this for a row go through turns with single members of the largest component,
#: as long as a turn leaves at most this share of the pairs.
PAIRS_A_ROW = 16
HUB_GAIN = 0.95


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted by value."""
    hashes = word_hashes(raw and raw.lower())  # of bytes, lower() changes A-Z only
    return np.unique(window_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40)).astype(np.int64) % SLOTS


def gram_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Rank of each slot of the counter table by its documents, over the whole corpus: 32 MB, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint16)  # of one task; what is above counts as 65535, which is frequent enough
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                slots = np.unique(_slot(shingle_set(raw, size)))
                counts[slots] += counts[slots] < 0xFFFF
        # most slots of a task hold 0 or 1, so they are sent compressed
        parts = [zlib.compress(part.tobytes(), 1) for part in _narrow(counts).reshape(-1, SLOT_BLOCK)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOT_BLOCK, np.int64)
        for part in frame["counts"]:
            total += _wide(part)
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "counts": [packed]})

    schema = "block int, counts binary"
    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.uint16)
    for row in rows:  # only the order matters: exact below 2048, in steps of a share of 1/1900 of a doubling above
        wide = _wide(row["counts"]).astype(np.int64)
        out[row["block"]] = np.where(wide < 2048, wide, 2048 + 1900 * (np.log2(np.maximum(wide, 2048)) - 11)).astype(np.uint16)
    return out.ravel()


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max())))


def _wide(packed: bytes) -> np.ndarray:
    """The counts of a block; their width follows from its length."""
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, f"<u{len(raw) // SLOT_BLOCK}")


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which one must be shared with any set that reaches the threshold."""
    return n - -(-n * percent // 100) + 1


def _digests(counts: Broadcast, size: int, percent: int):
    fields = [("doc_id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("prefix", pa.list_(pa.int64()))]
    schema = pa.schema([*fields, ("bins", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                grams = shingle_set(text, size)
                n = len(grams)
                raw = grams.tobytes()
                seeds = (xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63) for seed in (1, 2))
                take = prefix_length(n, percent) if n else 0
                order = np.argsort(frequency[_slot(grams)], kind="stable")[:take]  # ties: by value
                bins = np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=BINS)
                rows.append((doc_id, n, *seeds, grams[order].view(np.int64), bins))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def id_filter(ids: DataFrame, name: str) -> bytes:
    """A bitmap of the hashes of ids, of fixed size: tells which rows cannot be among them before they are shuffled."""
    slot = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)) + 1  # Spark numbers the buckets of positive values from 1
    parts = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")
    )
    out = bytearray(FILTER_BITS // 8)
    for row in parts.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = row["m"]
    return bytes(out)


def _bit(bitmap: bytes, slots: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint8)
    return (bits[slots >> 3] >> (slots & 7) & 1).astype(bool)


def _filter_slot(value: Column | str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))


def in_filter(bitmap: Broadcast, name: str) -> Column:
    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        return pd.Series(_bit(bitmap.value, slots.to_numpy()))

    # else Spark would repeat the test on whatever is joined by this column
    return test.asNondeterministic()(_filter_slot(name))


def _held_grams(sets: DataFrame, ids: Broadcast, grams: Broadcast) -> DataFrame:
    """``pos, gram, rep, n`` of the prefix shingles in one bitmap, of the documents in the other.

    One step in Python for both: with a test after another, each task would hold two workers, which then stay.
    """
    schema = pa.schema([("pos", pa.int32()), ("gram", pa.int64()), ("rep", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_bit(ids.value, batch.column(3).to_numpy())))
            found, slots = batch.column(2).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            held = np.flatnonzero(_bit(grams.value, slots))
            row = np.repeat(np.arange(len(sizes)), sizes)[held]
            pos = held - (np.cumsum(sizes) - sizes)[row]
            ns = batch.column(1).to_numpy()
            columns = (pos.astype(np.int32), found[held], batch.column(0).to_numpy()[row], ns[row])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    rows = sets.select("doc_id", "n", "prefix", _filter_slot("doc_id"), F.transform("prefix", _filter_slot))
    return rows.mapInArrow(run, "pos int, gram long, rep long, n int")


def _overlap(size: int, percent: int):
    """The pairs that reach the threshold. Rows come in runs of one b, whose set is kept."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            texts = zip(raw_texts(batch.column(2)), raw_texts(batch.column(3)))
            for b, (text_a, text_b) in zip(batch.column(1).to_pylist(), texts):
                if held != (b, text_b):
                    held, kept = (b, text_b), shingle_set(text_b, size)
                grams = shingle_set(text_a, size)
                shared = len(np.intersect1d(grams, kept, assume_unique=True))
                good.append(100 * shared >= percent * (len(grams) + len(kept) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold, each checked once. ``pairs`` has no pair twice."""
    bins = classes.select("rep", "n", "bins")
    pairs = pairs.join(bins.toDF("a", "na", "ba"), "a").join(bins.toDF("b", "nb", "bb"), "b")
    pairs = pairs.filter(_reaches(F.least("na", "nb"), percent, "na", "nb"))
    bound = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    pairs = stored(pairs.filter(_reaches(bound, percent, "na", "nb")).select("a", "b").distinct(), "pairs")
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"))
    texts = docs.filter(in_filter(bitmap, "doc_id"))
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = both.select("a", "b", "text_a", "text_b").mapInArrow(_overlap(size, percent), "a long, b long").distinct()
    links = stored(links, name)
    discard(pairs)
    bitmap.unpersist()
    return links


def _reaches(overlap: Column, percent: int, a: str, b: str) -> Column:
    """100 * overlap >= percent * union for sets of ``a`` and ``b`` shingles."""
    return (100 + percent) * overlap.cast("long") >= percent * (F.col(a) + F.col(b)).cast("long")


def _placed_to_reach(percent: int) -> Column:
    """Positional filter of rows ``_a`` and ``_b`` of one shingle: what can be common before, at and after it is enough."""
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    bound = F.least("earlier_a", "earlier_b") + rest
    return _reaches(F.least(bound, "n_a", "n_b"), percent, "n_a", "n_b")


def _parts(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their component, and the shingles in several of them: largest one, classes, classes outside it."""
    placed = rows.drop("hub").join(splittable(found.withColumnRenamed("id", "rep")), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    sizes = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("gram").agg(
        F.max_by("component", F.struct("c", "component")).alias("major"), F.count(F.lit(1)).alias("k"),
        F.sum("c").alias("c"), (F.sum("c") - F.max("c")).alias("minor"),
    )
    return placed, largest.filter("k > 1").drop("k")


def _hub_pairs(near: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each class outside a shingle's largest component with one member of it, another one for each shingle and turn.

    Drawn is, from a half of the members that changes by turn, one with the fewest shingles of its own before this one: what
    a copy has of its own comes from its edits, so these are near to most others.
    """
    columns = ["rep", "n", "pos", "earlier"]
    half, own = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(2)), F.col("pos") - F.col("earlier")
    drawn = F.struct(half, own, F.xxhash64("rep", "gram", F.lit(turn)), "rep", "pos")
    hubs = near.filter("component = major").groupBy("gram").agg(F.min_by(F.struct(*columns), drawn).alias("h"))
    hubs = hubs.select("gram", *(F.col(f"h.{c}").alias(f"{c}_b") for c in columns))
    minor = near.filter("component <> major").select("gram", *(F.col(c).alias(f"{c}_a") for c in columns))
    pairs = minor.join(splittable(hubs), "gram").filter(_placed_to_reach(percent))
    return pairs.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest id that links of at least ``percent`` reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(gram_counts(docs, size))
    digests = docs.mapInArrow(
        _digests(counts, size, percent), "doc_id long, n int, h1 long, h2 long, prefix array<long>, bins array<int>"
    )
    digests = stored(digests, "digests")
    counts.unpersist()
    sets = digests.filter("n > 0 AND doc_id IS NOT NULL")
    reps = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    members = sets.select("doc_id", "n", "h1", "h2").join(splittable(reps), ["h1", "h2"]).select("doc_id", "n", "h1", "rep")
    members = stored(members, "members")
    # the representative's own row carries the prefix. The bitmap lets a few copies through, which then link as any other
    # class does; it saves shuffling the prefixes to their class
    bitmap = spark.sparkContext.broadcast(id_filter(members.filter("doc_id = rep"), "doc_id"))
    classes = sets.filter(in_filter(bitmap, "doc_id")).select(F.col("doc_id").alias("rep"), "n", "bins", "prefix")
    grams = classes.select(F.posexplode("prefix").alias("pos", "gram"), "rep", "n")
    shared = grams.groupBy("gram").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = stored(shared.select("gram", "hub"), "shared-grams")
    held = spark.sparkContext.broadcast(id_filter(shared, "gram"))
    rows = _held_grams(sets, bitmap, held).join(shared, "gram")
    # how many prefix shingles that anyone shares stand before this one: no more can be common before it
    order = Window.partitionBy("rep").orderBy("pos")
    rows = stored(rows.withColumn("earlier", F.dense_rank().over(order) - 1), "shared")
    discard(shared)
    held.unpersist()

    # stars: each class with the smallest class of each of its prefix shingles
    stars = rows.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    stars = stored(stars.distinct(), "star-pairs")
    first = _verified(stars, docs, classes, size, percent, "star-links")
    found = stored(components(first), "star-components")

    # what is left: shingles whose classes lie in several components. Where they would give long lists of pairs, the smaller
    # components meet single members of the largest first, as long as that brings them together
    tried, linked, last = [stars], [first], None
    while True:
        placed, parts = _parts(rows, found)
        parts = stored(parts, "parts")
        pairs, taken = parts.agg(F.sum(F.col("c") * F.col("minor")), F.sum("c")).first()
        if not pairs or pairs <= PAIRS_A_ROW * taken or (last and pairs > HUB_GAIN * last):
            break
        last = pairs
        heavy = splittable(parts.filter(F.col("minor") > PAIRS_A_ROW).select("gram", "major"))
        near = stored(placed.join(heavy, "gram"), "near")
        met = _hub_pairs(near, len(tried), percent)
        for old in tried:
            met = met.join(old, ["a", "b"], "left_anti")
        met = stored(met, "hub-pairs")
        discard(near, parts)
        tried.append(met)
        linked.append(_verified(met, docs, classes, size, percent, "hub-links"))
        joined = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(linked[-1])
        known, found = found, stored(components(joined), "hub-components")
        discard(known)
    mixed = placed.join(splittable(parts.select("gram", "major")), "gram")
    # an id with several texts has one list of places for all of them, so it looks nothing up
    texts = members.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi")
    mixed = mixed.join(splittable(texts.select(F.col("doc_id").alias("rep"), F.lit(True).alias("several"))), "rep", "left")
    before = F.collect_list("gram").over(order.rowsBetween(-BEFORE, -1))
    before = F.when(F.col("several"), F.array().cast("array<long>")).otherwise(before)
    mixed = stored(mixed.withColumn("before", before).drop("several"), "mixed")
    minor = mixed.filter("component <> major")
    columns = ["rep", "n", "pos", "earlier", "component", "before"]
    x = minor.select("gram", *(F.col(c).alias(f"{c}_a") for c in columns))
    y = mixed.select("gram", *(F.col(c).alias(f"{c}_b") for c in [*columns, "major"]))
    pairs = x.join(y, "gram").filter(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("major_b")) | (F.col("rep_a") < F.col("rep_b")))
        & _placed_to_reach(percent)
        & ~F.arrays_overlap("before_a", "before_b")
    )
    pairs = pairs.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct()
    for old in tried:
        pairs = pairs.join(old, ["a", "b"], "left_anti")
    more = _verified(pairs, docs, classes, size, percent, "links")
    discard(rows, mixed, parts, *tried)

    # an id with several texts links their classes
    several = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).filter("b < hi").drop("hi")
    several = members.join(splittable(several), "doc_id").select(F.col("rep").alias("a"), "b")
    links = more.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))).unionByName(several)
    final = splittable(components(links).withColumnRenamed("id", "rep"))
    discard(found, more, *linked)
    out = members.join(final, "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = digests.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
