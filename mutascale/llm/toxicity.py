"""Toxicity scores: a lexicon learnt from labels, matched with misspellings, and weighed by context.

1. Lexicon. In a bounded hash sample of labelled documents, words and word beginnings are counted per label; those that
   mark toxic documents far beyond chance enter the lexicon, the shortest beginning that is as precise as what follows it.
2. Matching. The lexicon is a trie; it is intersected with Levenshtein automata by walking sets of (node, edits) states, and
   the states met are kept as one lazily built automaton, so most words are refused after a few letters. Terms of
   five letters and more may have one edit, of nine and more two, at any letter. Digits and symbols cut words, but words
   so joined that match no term by themselves are also read as one (``m0ron``, ``st*pid``); white space always cuts.
3. Context. The words around each match in the sample give a log-odds score per context word; a match inside quotation marks, or
   in a window that speaks for quotation, counts as quoted rather than as abuse.
4. Score. A logistic model over the counts of exact, misspelt and quoted matches and their density.

Defined results: null and empty texts have no match and get the score of a text without any. Repeated rows are scored each.
Labels that are null or no 0/1 are ignored; without labels of both classes the score is the share of toxic labels (one
count added to each class). An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.llm.texts import stored

TOKEN = re.compile(r"[^\W\d_]+")
#: Runs of letters with digits or symbols between them; more than two of these in a row are more edits than a term may have.
CHUNK = re.compile(r"[^\W\d_]+(?:(?:[^\w\s]|[\d_]){1,2}[^\W\d_]+)*")
#: Characters that open or close a quotation.
QUOTES = "\"'“”„«»‹›‘’`"
SPAN = 4
FEATURES = 6
#: Letters that a beginning may have.
BEGINS = range(4, 10)


class Matcher:
    """Trie of terms met by all words within a few edits.

    A term ``clown`` is a whole word; ``clown*`` also starts longer words. States are sets of (node, edits so far).
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool]]] = [[]]
        self.most = [0]  # edits that a term below a node may still have
        for number, term in enumerate(terms):
            word, open_end = term.rstrip("*"), term.endswith("*")
            limit = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
            node = 0
            self.most[0] = max(self.most[0], limit)
            for letter in word:
                if letter not in self.moves[node]:
                    self.moves[node][letter] = len(self.moves)
                    self.moves.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.moves[node][letter]
                self.most[node] = max(self.most[node], limit)
            self.ends[node].append((number, limit, open_end))
        self.forget()

    def forget(self) -> None:
        """The lazily built automaton starts anew."""
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = []
        self.number: dict[frozenset, int] = {}
        self.words: dict[str, tuple[int, int] | None] = {}
        self.chunks: dict[str, list[tuple[int, int, int, int]]] = {}
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a state; letters that a word lacks are skipped first."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            if edits > reached[node]:
                continue
            for child in self.moves[node].values():
                if edits < self.most[child] and edits + 1 < reached.get(child, 99):
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        key = frozenset(reached.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, t, o) for n, e in key for t, limit, o in self.ends[n] if e <= limit]
            best = min(((e, t) for e, t, _ in ends), default=None)
            started = min(((e, t) for e, t, o in ends if o), default=None)
            self.final.append((best, started))
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < reached.get(node, 99):
                reached[node] = edits

        for node, edits in self.states[state]:
            put(node, edits + 1)
            for other, child in self.moves[node].items():
                put(child, edits + (other != letter))
        to = self._state(reached) if reached else -1
        self.steps[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term, or None."""
        try:
            return self.words[word]
        except KeyError:
            pass
        if len(self.words) > 400_000 or len(self.states) > 100_000:
            self.forget()
        found, state = None, self.start
        for letter in word:
            to = self.steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                break
            started = self.final[state][1]
            if started and (found is None or started < found):
                found = started
        else:
            best = self.final[state][0]
            if best and (found is None or best < found):
                found = best
        self.words[word] = found
        return found

    def found(self, chunk: str) -> list[tuple[int, int, int, int]]:
        """(first word, last word, edits, number of the term) of each match in words joined by digits or symbols.

        Words that match go by themselves; what lies between them is also read with the digits and symbols.
        """
        if chunk.isalpha():
            own = self.match(chunk)
            return [(0, 0, *own)] if own else []
        if chunk in self.chunks:
            return self.chunks[chunk]
        if len(self.chunks) > 200_000:
            self.forget()
        words = list(TOKEN.finditer(chunk))
        own = [self.match(w.group()) for w in words]
        out, at = [], 0
        while at < len(words):
            if own[at]:
                out.append((at, at, *own[at]))
                at += 1
                continue
            best = self._joined(chunk, words, own, at)
            if best:
                edits, term, last = best
                out.append((at, last, edits, term))
            at = best[2] + 1 if best else at + 1
        self.chunks[chunk] = out
        return out

    def _joined(self, chunk: str, words: list[re.Match], own: list, first: int) -> tuple[int, int, int] | None:
        """(edits, number of the term, last word) of the nearest term that two or more words from ``first`` on make up."""
        best, state, begin = None, self.start, words[first].start()
        for last in range(first, len(words)):
            if own[last]:
                break
            started = None
            for letter in chunk[begin : words[last].end()]:
                to = self.steps[state].get(letter)
                state = self._step(state, letter) if to is None else to
                if state < 0:
                    break
                started = min(filter(None, (started, self.final[state][1])), default=None)
            whole = self.final[state][0] if state >= 0 else None
            near = min(filter(None, (started, whole)), default=None)
            if near and last > first and (best is None or near < best[:2]):
                best = (*near, last)
            if state < 0:
                break
            begin = words[last].end()
        return best


def matches(text: str, matcher: Matcher) -> Iterator[tuple[int, int, bool, list[str]]]:
    """(term, edits, in quotation marks, context words) of each match in a text."""
    lower = text.lower()
    hits = {c: found for c in set(CHUNK.findall(lower)) if (found := matcher.found(c))}
    if not hits:
        return
    tokens, after = list(TOKEN.finditer(lower)), 0
    for chunk in CHUNK.finditer(lower):
        begin = after
        while after < len(tokens) and tokens[after].end() <= chunk.end():
            after += 1
        for first, last, edits, term in hits.get(chunk.group(), ()):
            first, last = begin + first, begin + last
            near = tokens[max(0, first - SPAN) : first] + tokens[last + 1 : last + 1 + SPAN]
            left = lower[max(0, tokens[first].start() - 40) : tokens[first].start()]
            right = lower[tokens[last].end() : tokens[last].end() + 40]
            quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
            yield term, edits, quoted, [t.group() for t in near]


class Model:
    """What the executors need: terms, weights of context words, and the logistic model. Its size is bounded."""

    def __init__(self, terms: list[str], context: dict[str, float], weights: np.ndarray):
        self.terms, self.context, self.weights = terms, context, weights

    def features(self, text: str | None, matcher: Matcher) -> list[float]:
        exact = fuzzy = quoted = 0
        kinds = set()
        for term, edits, marked, near in matches(text or "", matcher):
            speaks = sum(self.context.get(w, 0.0) for w in near)
            if marked or speaks < -1.0:
                quoted += 1
            elif edits:
                fuzzy += 1
            else:
                exact += 1
                kinds.add(term)
        size = max(1, len(text or "") / 1000)
        return [1.0, *np.log1p([exact, fuzzy, quoted, len(kinds), (exact + fuzzy) / size])]

    def score(self, features: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, features), -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the intercept and is hardly penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(items: Callable) -> Callable:
    """A task that sums label counts of what ``items(text, label)`` yields before anything is shuffled."""
    schema = pa.schema([("item", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])

    def flush(counts: list[Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [names, [counts[1][n] for n in names], [counts[0][n] for n in names]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[label].update(items(text.as_py() or ""))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush(counts)
                    counts = [Counter(), Counter()]
        yield flush(counts)

    return run


def _parts(text: str) -> set[str]:
    """Each distinct word as ``word`` and its beginnings as ``begin*``."""
    out = set()
    for word in set(TOKEN.findall(text.lower())):
        if 3 <= len(word) <= 40:
            out.add(word)
            out.update(f"{word[:n]}*" for n in BEGINS if n < len(word))
    return out


def choose_terms(counts: list[tuple[str, int, int]], bad: int, good: int, precision: float) -> list[str]:
    """All terms whose documents are toxic beyond chance: precise whole words, and the shortest precise beginnings."""
    rate = bad / (bad + good)
    strong = {}
    for item, b, g in counts:
        n = b + g
        z = (b - n * rate) / sqrt(n * rate * (1 - rate))
        if (b + 0.5) / (n + 1) >= precision and z >= 6:
            strong[item] = b
    words = [w for w in strong if not w.endswith("*")]
    whole: Counter = Counter()  # per beginning, the documents of its most frequent word
    for word in words:
        for n in BEGINS:
            whole[word[:n]] = max(whole[word[:n]], strong[word])
    begins: set[str] = set()

    def covered(word: str) -> bool:
        return any(word[:n] in begins for n in BEGINS)

    for item in sorted((i for i in strong if i.endswith("*")), key=lambda i: (len(i), i)):
        # a beginning that one word accounts for is only the start of that word
        if not covered(item[:-1]) and strong[item] >= 1.3 * whole[item[:-1]]:
            begins.add(item[:-1])
    return sorted([f"{b}*" for b in begins] + [w for w in words if not covered(w)])


def learn(train: DataFrame, max_rows: int, precision: float = 0.8) -> Model:
    """Fit on ``text, label, doc_id`` rows; a hash sample of about ``max_rows`` of them is used, and it is all that is bounded.

    Every item that passes its test enters the lexicon, and every word that stands near matches five times, by three standard
    deviations more or less near toxic ones, has a weight. Both grow with the sample alone, not with the documents scored.
    """
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    total = sum(seen.values())
    share = int(min(1.0, max_rows / total) * (1 << 30)) if total else 0
    sample = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("text", "label")
    if not seen.get(0) or not seen.get(1):
        start = np.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1))
        return Model([], {}, np.array([start, *[0.0] * (FEATURES - 1)]))
    sample = stored(sample, "toxic-sample")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = size.get(1, 0) or 1, size.get(0, 0) or 1
    schema = "item string, bad long, good long"
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    counts = sample.mapInArrow(_counted(_parts), schema).groupBy("item").agg(*sums)
    # only items that pass the test leave the executors
    n, rate = F.col("bad") + F.col("good"), bad / (bad + good)
    z = (F.col("bad") - n * rate) / F.sqrt(n * rate * (1 - rate))
    counts = counts.filter((F.col("bad") + 0.5 >= precision * (n + 1)) & (z >= 6))
    terms = choose_terms([tuple(r) for r in counts.collect()], bad, good, precision)

    def around(text: str) -> Iterator[str]:
        for _, _, _, near in matches(text, held(terms)):
            yield from near

    context = sample.mapInArrow(_counted(around), schema).groupBy("item").agg(*sums)
    context = stored(context, "toxic-context")
    near_bad, near_good = (1 + (x or 0) for x in context.agg(F.sum("bad"), F.sum("good")).first())
    base = np.log(near_bad / near_good)
    # words that stand near toxic and other matches alike would only add noise
    share = near_bad / (near_bad + near_good)
    apart = F.abs(F.col("bad") - n * share) >= 3 * F.sqrt(n * share * (1 - share))
    rows = context.filter((n >= 5) & apart).collect()
    scores = {r["item"]: float(np.log((r["bad"] + 1) / (r["good"] + 1)) - base) for r in rows} if near_good > 20 else {}
    model = Model(terms, scores, np.zeros(FEATURES))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t.as_py(), held(terms)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    sums = sample.mapInArrow(featured, "x array<double>, label int").groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    x, y, n = np.array([r["x"] for r in sums]), np.array([r["label"] for r in sums]), np.array([r["n"] for r in sums])
    model.weights = fit_logistic(np.repeat(x, n, axis=0), np.repeat(y, n))
    return model


_HELD: dict[tuple, Matcher] = {}


def held(terms: list[str]) -> Matcher:
    """The matcher of a lexicon, built once in a Python worker."""
    key = tuple(terms)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Matcher(terms)
    return _HELD[key]


def score(
    docs: DataFrame, labels: DataFrame, is_train: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", threshold: float = 0.7, max_rows: int = 20_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Only labels of ids for which ``is_train`` holds are learnt from; ``held_out`` is its negation.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & is_train(F.col("doc_id")))
    n = known.count()
    # thinned before the texts are joined; the same ids pass the filter in learn()
    share = int(min(1.0, max_rows / n) * (1 << 30)) if n else 0
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    train = stored(docs.join(known, "doc_id").select("doc_id", "text", "label"), "toxic-train")
    model = learn(train, max_rows=2 * max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        matcher = held(model.terms)
        for batch in batches:
            values = [model.score(model.features(t.as_py(), matcher)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.withColumn("held_out", F.coalesce(~is_train(F.col("doc_id")), F.lit(False)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("doc_id", id_col)
