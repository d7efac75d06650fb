"""Removal of repeated passages: documents are streamed through suffix automata of the passages that came first.

A window is ``window`` consecutive words. Each word covered by a window that also starts in a document with a smaller id is
removed; windows are judged on the input, not on what is left.

1. Of the ``gram``-word runs in each window, the one with the smallest hash is its anchor; equal windows have equal anchors.
   Copies of one text are reduced to the smallest id before anchors are counted, and anchors of one document only are
   dropped. This leaves the few windows that may repeat.
2. These windows are compared by a 64-bit hash. The owner of a repeated window is the smallest document that holds it.
3. The reference is cut into shards: the passages that one document owns, so a shard is never larger than a document. Its
   suffix automaton is built where the shard meets the runs of windows that others share with it. The runs of a shard are
   dealt into parts of about ``PART_BYTES``, and the shard is sent once to each part, not to each run. Each run is streamed
   through the automaton; where the matching statistic reaches the window length, the words of the match are a removed span.
   So these removals rest on equal words; a copy of a whole text does not pass through the automaton and goes by a 128-bit
   digest.

Defined results: a null or empty text has no words and the digest of the empty string. A row with a null id has no order:
nothing of it is removed and it removes nothing. A document is an id with a text: rows repeated with both come back each, and
an id with several texts has spans of its own for each of them. Rows of one id, equal or not, do not remove each other's
words. A text of any length is hashed in blocks; its words are held in memory by the task that has it. An empty table gives
an empty result. Only the named columns are read, and those that are to be carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mutascale.llm.texts import discard, raw_texts, splittable, stored, window_hashes, word_hashes, words_of


def anchor_places(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's place, and the hashes of all runs of ``gram`` words."""
    grams = window_hashes(hashes, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, np.int64), grams
    return sliding_window_view(grams, span).argmin(1) + np.arange(len(grams) - span + 1), grams


class SuffixAutomaton:
    """Of several passages: their words are added one by one, each passage from the start state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _clone(self, source: int, word) -> int:
        target = self.next[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._new(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = copy
            source = self.link[source]
        return copy

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, word) -> int:
        if word in self.next[last]:  # another passage went this way
            return self._clone(last, word)
        state, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._clone(at, word)
        return state

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by matches of at least ``least`` words."""
        out: list[tuple[int, int]] = []
        state, matched = 0, 0
        for end, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= least:
                start = end - matched
                if out and out[-1][1] >= start:
                    out[-1] = (min(out[-1][0], start), end)
                else:
                    out.append((start, end))
        return out


#: Bytes of runs that are sent to Python with one copy of their reference.
PART_BYTES = 1 << 20


def _batches(columns: Iterator[list], schema: pa.Schema, rows: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in columns:
        held.append(row)
        if len(held) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _anchors(window: int, gram: int):
    """A row per document with a window: its id, the key of its text, and the distinct anchors."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                    places, grams = anchor_places(word_hashes(raw), window, gram)
                    if len(places):
                        yield doc_id, key, np.unique(grams[np.unique(places)]).view(np.int64)

        yield from _batches(rows(), schema, 1000)

    return run


def _windows(window: int, gram: int):
    """The hash and place of each window whose anchor is among the document's shared ones."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, key, raw, shared in zip(ids, keys, raw_texts(batch.column(2)), batch.column(3)):
                hashes = word_hashes(raw)
                places, grams = anchor_places(hashes, window, gram)
                known = np.asarray(shared.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                at = np.flatnonzero(np.isin(grams[places], known))
                if len(at):
                    found = window_hashes(hashes, window)[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.view(np.int64)), pa.array(np.full(len(at), doc_id)),
                            pa.array([key] * len(at), pa.binary()), pa.array(at.astype(np.int32)),
                        ],
                        schema=schema,
                    )

    return run


def _passages(window: int):
    """Owned passages of each document (one row) and its runs of windows that others own (a row for each)."""
    schema = pa.schema([
        ("owner", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("start", pa.int32()),
        ("texts", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc_id, key, raw, found in zip(ids, keys, raw_texts(batch.column(2)), batch.column(3)):
                    words = words_of(raw)
                    place = np.asarray(found.values.field("place").to_numpy(zero_copy_only=False))
                    owner = np.asarray(found.values.field("owner").to_numpy(zero_copy_only=False))
                    place, order = np.unique(place, return_index=True)  # a repeated row has each of its windows again
                    owner = owner[order]
                    cuts = np.flatnonzero((np.diff(place) != 1) | (np.diff(owner) != 0)) + 1
                    own = []
                    for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
                        passage = b" ".join(words[place[lo] : place[hi - 1] + window])
                        if owner[lo] == doc_id:
                            own.append(passage)
                        else:
                            yield int(owner[lo]), doc_id, key, int(place[lo]), [passage]
                    if own:
                        yield doc_id, doc_id, key, 0, own

        yield from _batches(rows(), schema, 500)

    return run


def _match(window: int):
    """Stream the runs of a part through the automaton of their owner's passages; gives the spans within the documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for reference, runs in zip(batch.column(0), batch.column(1)):
                    automaton = SuffixAutomaton()
                    for passage in reference.as_py():
                        automaton.add(passage.split(b" "))
                    for row in runs.as_py():
                        for start, end in automaton.spans(row["text"].split(b" "), window):
                            yield row["doc_id"], row["key"], row["start"] + start, row["start"] + end

        yield from _batches(rows(), schema)

    return run


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for start, end in spans:
        keep[start:end] = False
    return [w for w, k in zip(words, keep) if k]


def removed_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, key, spans`` of the documents that lose words. ``docs`` has ``doc_id`` (not null), ``key``, which tells texts
    apart, and ``text``.

    A copy of a whole text has one span over all its words.
    """
    anchors = stored(
        docs.select("doc_id", "key", "text").mapInArrow(_anchors(window, gram), "doc_id long, key binary, anchors array<long>"),
        "anchors",
    )
    reps = anchors.groupBy("key").agg(F.min("doc_id").alias("rep"))
    keyed = anchors.select("doc_id", "key").join(splittable(reps), "key")
    copies = keyed.filter("doc_id > rep").select("doc_id", "key").distinct()
    chosen = keyed.filter("doc_id = rep").select("doc_id", "key").distinct()
    listed = anchors.join(chosen, ["doc_id", "key"], "left_semi").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = listed.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    known = listed.join(splittable(shared.select("anchor")), "anchor", "left_semi")
    known = stored(known.groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")

    texts = docs.join(known, ["doc_id", "key"]).select("doc_id", "key", "text", "anchors")
    windows = texts.mapInArrow(_windows(window, gram), "hash long, doc_id long, key binary, place int")
    windows = stored(windows, "windows")
    owners = windows.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).filter("owner < hi")
    found = windows.join(splittable(owners.select("hash", "owner")), "hash").groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("place", "owner")).alias("found")
    )
    passages = docs.join(found, ["doc_id", "key"]).select("doc_id", "key", "text", "found").mapInArrow(
        _passages(window), "owner long, doc_id long, key binary, start int, texts array<binary>"
    )
    passages = stored(passages, "passages")
    discard(known, windows)
    shards = passages.filter("owner = doc_id").groupBy("owner").agg(F.flatten(F.collect_list("texts")).alias("reference"))
    runs = passages.filter("owner < doc_id").select("owner", "doc_id", "key", "start", F.col("texts")[0].alias("text"))
    # the runs of an owner in parts, each met by one copy of the reference
    sizes = runs.groupBy("owner").agg(F.ceil(F.sum(F.length("text") + 64) / PART_BYTES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id", "key", "start"), F.col("parts")).cast("int").alias("part")
    parts = runs.join(splittable(sizes), "owner").select("owner", part, F.struct("doc_id", "key", "start", "text").alias("run"))
    parts = parts.groupBy("owner", "part").agg(F.collect_list("run").alias("runs"))
    met = parts.join(splittable(shards), "owner").select("reference", "runs")
    spans = met.mapInArrow(_match(window), "doc_id long, key binary, start int, end int").distinct()
    whole = copies.select("doc_id", "key", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))
    return spans.unionByName(whole).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20,
    keep_text: bool = True, carry: list[str] | None = None,
) -> DataFrame:
    """Every row as ``doc_id, n_words, n_removed, kept_sha256`` and, if wanted, ``kept_text``.

    The kept words are joined by one space. A row that loses nothing has its text unchanged in ``kept_text``. The columns
    ``carry`` of the row come back in a struct ``carried``, so no join is needed to find it.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried") if carry else F.lit(0).alias("carried")
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text"), own
    )
    spans = removed_spans(docs.filter("doc_id IS NOT NULL").drop("carried"), window, gram)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, found in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2)):
                words, found = words_of(raw), found.as_py()
                kept = _kept(words, [(s["start"], s["end"]) for s in found]) if found else words
                joined = b" ".join(kept)
                row = (doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest())
                text = joined if found else raw
                rows.append((*row, text if text is None else text.decode()) if keep_text else row)
            columns = list(zip(*rows)) or [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    schema = StructType([*StructType.fromDDL(columns).fields, docs.schema["carried"]])
    names = schema.fieldNames()
    result = docs.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans", "carried").mapInArrow(run, schema)
    return result if carry else result.drop("carried")
