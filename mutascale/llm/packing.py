"""Bounded-space online packing of tokenised documents.

Each task reads its documents once and keeps ``open_windows`` unfinished sequences. A document longer than a sequence gives
full sequences; what is left goes best-fit into the open sequence with the smallest gap that holds it. When none fits, a new
one is opened or, at the bound, the fullest is emitted: if its gap takes at least ``min_cut`` ids it is closed with the start
of the piece, and the rest is placed again. At the end the open sequences of a task, at most ``open_windows``, are handed on
and merged across ``merge_tasks`` tasks; there pieces are cut at the ends of the sequences, and the last, unfinished sequence
becomes sequences of powers of two, which need no padding.

Defined results: a null or empty text is the single id ``end_id``. A null id or repeated rows are packed as any other row.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.llm.texts import blocks, raw_texts, stored, word_bounds, word_hashes

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
MERGED = 1 << 62
#: Letters, then characters that compose with none and are punctuation in every version of Unicode.
PLAIN = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-^`{-~«»–—‘’“”„…]*)$")


#: Bytes of text that are looked up together, and the length of a word above which its ids are not kept.
PORTION = 2 << 20
MOST_KEPT = 64


class WordIds:
    """Ids of texts, for tokenizers that drop white space, never join across it, compose characters (NFC), lower the case,
    and cut letters from punctuation.

    The words of a batch are told apart by a 64-bit hash, and each distinct one is looked up once. A word of plain letters
    with common punctuation after it goes by its lower-case letters, which are far fewer; any other word, as one with a mark
    that composes with a letter, is looked up whole. The last ``limit`` to ``2 * limit`` of these are kept,
    and at most one and a half times ``limit`` from task to task.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.young: dict[bytes, bytes] = {}  # ids as unsigned 32-bit integers: far smaller than a tuple of numbers
        self.old: dict[bytes, bytes] = {}

    def rest(self) -> None:
        """Between tasks: keep about one generation of words, and give back the free blocks of Arrow's pool."""
        if 2 * len(self.young) >= self.limit:
            self.old = {}
        pa.default_memory_pool().release_unused()

    def word(self, raw: bytes) -> bytes:
        ids = self.young.get(raw)
        if ids is not None:
            return ids
        ids = self.old.get(raw)
        if ids is None:
            word = raw.decode()
            plain = PLAIN.match(word)
            letters = plain[1].lower().encode() if plain else raw
            if letters == raw:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                ids = self.word(letters)
                if plain[2]:
                    ids = ids + self.word(plain[2].encode())
        if len(raw) > MOST_KEPT:
            return ids
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[raw] = ids
        return ids

    def encode(self, raws: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text; a text longer than a portion is worked through in blocks."""
        if len(raws) == 1 and len(raws[0] or b"") > PORTION:
            return [np.concatenate([self._encode([block])[0] for block in blocks(raws[0], PORTION)])]
        return self._encode(raws)

    def _encode(self, raws: list[bytes | None]) -> list[np.ndarray]:
        text = b"\n".join(raw or b"" for raw in raws)
        ends_of = np.cumsum([len(raw or b"") + 1 for raw in raws])
        starts, ends = word_bounds(text)
        if not len(starts):
            return [np.empty(0, np.uint32) for _ in raws]
        _, first, which = np.unique(word_hashes(text), return_index=True, return_inverse=True)
        ids = [self.word(text[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(sizes) - sizes
        # the place of each id of each word in the flat list of the distinct words' ids
        sizes = sizes[which]
        upto = np.cumsum(sizes)
        out = flat[np.repeat(begin[which] - (upto - sizes), sizes) + np.arange(upto[-1])]
        cuts = np.searchsorted(starts, ends_of[:-1])
        return np.split(out, np.concatenate([[0], upto])[cuts])


#: One per tokenizer file in a Python worker, kept from task to task.
_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes | None]]]:
    """Ids and texts of a batch in portions of about ``PORTION`` bytes; a longer text is a portion of its own."""
    keys, raws, size = [], [], 0
    for key, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
        if keys and size + len(raw or b"") > PORTION:
            yield keys, raws
            keys, raws, size = [], [], 0
        keys.append(key)
        raws.append(raw)
        size += len(raw or b"")
    if keys:
        yield keys, raws


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Best-fit packing into a bounded number of open windows. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, window: int, open_windows: int, min_cut: int):
        self.window, self.most, self.min_cut = window, open_windows, min_cut
        self.open: list[tuple[int, list]] = []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        """Place a document; yields the finished sequences."""
        start, total = 0, len(ids)
        while total - start >= self.window:
            yield [(doc_id, start, total, ids[start : start + self.window])]
            start += self.window
        while start < total:
            need = total - start
            gaps = [(self.window - fill, at) for at, (fill, _) in enumerate(self.open)]
            fitting = [x for x in gaps if x[0] >= need]
            if fitting:
                gap, at = min(fitting)
                fill, pieces = self.open[at]
                pieces.append((doc_id, start, total, ids[start:]))
                if gap == need:
                    self.open.pop(at)
                    yield pieces
                else:
                    self.open[at] = (fill + need, pieces)
                return
            if len(self.open) < self.most:
                self.open.append((need, [(doc_id, start, total, ids[start:])]))
                return
            gap, at = min(gaps)
            _, pieces = self.open.pop(at)
            if gap >= self.min_cut:
                pieces.append((doc_id, start, total, ids[start : start + gap]))
                start += gap
            yield pieces


def rows(pieces: list, sequence_id: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, total, ids in pieces:
        yield doc_id, start, len(ids), crc32(ids), total, sequence_id, offset
        offset += len(ids)


def _pack_task(path: str, window: int, open_windows: int, min_cut: int, end_id: int) -> Callable:
    schema = pa.schema(
        [(c, pa.int64()) for c in COLUMNS] + [("ids", pa.binary()), ("task", pa.int64())]
    )

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        words, packer, done, out = word_ids(path), Packer(window, open_windows, min_cut), 0, []
        for part in batches:
            for keys, raws in _portions(part):
                for doc_id, ids in zip(keys, words.encode(raws)):
                    for pieces in packer.add(doc_id, np.append(ids, np.uint32(end_id))):
                        out += [(*r, None, task) for r in rows(pieces, (task << 32) | done)]
                        done += 1
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        for _, pieces in packer.open:
            kept = rows(pieces, (task << 32) | done)
            out += [(*r, p[3].astype("<u4").tobytes(), task) for r, p in zip(kept, pieces)]
            done += 1
        if out:
            yield batch(out)
        words.rest()

    return run


def _merge(window: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Merge the open sequences of a few tasks: fill each sequence to its end, the last in powers of two."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"])
        total = int(frame["length"].sum())
        sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]
        out, done = [], 0
        pieces, room = [], sizes[0] if sizes else 0
        for row in frame.itertuples(index=False):
            ids, start = np.frombuffer(row.ids, dtype="<u4"), int(row.start)
            doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
            while len(ids):
                head = ids[:room]
                pieces.append((doc_id, start, int(row.doc_tokens), head))
                ids, start, room = ids[room:], start + len(head), room - len(head)
                if not room:
                    out += rows(pieces, MERGED | (int(key[0]) << 32) | done)
                    done += 1
                    pieces, room = [], sizes[done] if done < len(sizes) else 0
        return pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in COLUMNS})

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
    open_windows: int = 32, min_cut: int = 16, end_id: int = 1, merge_tasks: int = 8,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    The first pass is written to the shared folder, because two readers must see the same sequences. A merge group holds at
    most ``merge_tasks * open_windows`` unfinished sequences, whatever the input.
    """
    schema = f"{PIECE}, ids binary, task long"
    run = _pack_task(tokenizer_path, window, open_windows, min_cut, end_id)
    first = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "packed"
    )
    merged = (
        first.filter(F.col("ids").isNotNull())
        .groupBy(F.floor(F.col("task") / merge_tasks).alias("group"))
        .applyInPandas(_merge(window), PIECE)
    )
    return first.filter(F.col("ids").isNull()).select(*COLUMNS).unionByName(merged)
