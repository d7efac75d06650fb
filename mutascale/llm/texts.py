"""Words, hashes and scratch tables that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascale.session import remove_path, scratch_path

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD_RE = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_RE)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_RE), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text. ``bytes.split`` cuts at exactly the characters that ``WORD_RE`` leaves out."""
    return (raw or b"").split()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_CUT = re.compile(rb"[\x20\x09-\x0D]")
#: Texts are hashed in blocks of this many bytes, so what is allocated does not grow with the text.
BLOCK = 1 << 16
#: A random 64-bit value per byte, and the powers of an odd base with their inverses (modulo 2**64) for one block.
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    flags = np.ones(len(raw) + 2, bool)
    flags[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[0::2], edges[1::2]


def blocks(raw: bytes, most: int = BLOCK) -> Iterator[bytes]:
    """The text in blocks of at most ``most`` bytes that end at white space; a longer word is a block of its own."""
    at = 0
    while len(raw) - at > most:
        cut = max(raw.rfind(space, at, at + most + 1) for space in _SPACES)
        if cut < 0:
            after = _CUT.search(raw, at + most)
            cut = after.start() if after else len(raw)
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


def word_hashes(raw: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of random values of its bytes, from running sums over a block of the text.

    A word longer than a block goes by another hash of its bytes.
    """
    if not raw:
        return np.empty(0, np.uint64)
    if len(raw) <= BLOCK:
        return _block_hashes(raw)
    return np.concatenate([_block_hashes(block) for block in blocks(raw)])


def _block_hashes(raw: bytes) -> np.ndarray:
    if len(raw) > BLOCK:
        return np.array([xxhash.xxh3_64_intdigest(raw)], np.uint64)
    starts, ends = word_bounds(raw)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * _POWERS[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, one at a time."""
    return (value.as_py() for value in column.cast(pa.binary()))


def mix(values: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; empty when there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # windows of doubling length are combined, so a window of any size takes log(size) passes
    out, have, part, span, bits = None, 0, hashes, 1, size
    while bits:
        if bits & 1:
            piece = part[have : have + n]
            out = piece.copy() if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + piece)
            have += span
        bits >>= 1
        if bits:
            part = mix(part[:-span] * np.uint64(0xD6E8FEB86659FD93) + part[span:])
            span *= 2
    return mix(out + np.uint64(size))


def splittable(df: DataFrame) -> DataFrame:
    """An exchange between an aggregate and the join that reads it: only then can Spark split a hot key of the other side."""
    return df.hint("rebalance")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this runs, texts go to Python in batches of at most so many rows: both sides hold a batch in memory at once."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote; for those that nothing reads any more."""
    for table in tables:
        remove_path(table.sparkSession, table.scratch)
