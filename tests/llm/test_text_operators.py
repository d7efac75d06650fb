"""Substring dedup, n-gram join, host rules and texts against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from mutascale.llm import host_rules, ngram_join, substring_dedup, texts
from mutascale.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, spans string, n int, owner long, place string, rep long, hub long"


def rows(pairs, source="s"):
    return [(i, t, source, "x", None, 1, "y", 2, 3) for i, t in pairs]


def random_corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "ü.", "a,b"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [words(k) for k in (50, 55, 49, 70, 120)]
    out = [(10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "one"), (10_004, "the same 50 " * 40)]
    for i in range(n):
        text = words(rng.randint(1, 150))
        for p in rng.sample(passages, rng.randint(0, 3)):
            text[rng.randint(0, len(text)) : 0] = p
        out.append((i * 3, rng.choice([" ", "\n", " \t"]).join(text)))
    out += [(5, out[10][1]), (1000, out[12][1]), (1001, out[12][1] + " more"), out[13], (None, out[14][1])]
    out.append((2000, " ".join(words(20_000))))
    rng.shuffle(out)
    return out


def brute_dedup(pairs):
    first = {}
    for doc, text in pairs:
        w = WORDS.findall(text or "")
        for i in range(len(w) - 49):
            if doc is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in pairs:
        w = WORDS.findall(text or "")
        gone = set()
        for i in range(len(w) - 49):
            if doc is not None and first[tuple(w[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, seed):
    pairs = random_corpus(seed)
    df = spark.createDataFrame(rows(pairs), SCHEMA).repartition(5)
    result = Counter(tuple(r) for r in substring_dedup.dedup(df, keep_text=False).collect())
    assert result == brute_dedup(pairs)


def test_dedup_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame(rows([(1, passage), (2, f"a  b {passage}\nc"), (3, "x  y"), (4, None)]), SCHEMA)
    kept = {r.doc_id: r.kept_text for r in substring_dedup.dedup(df).collect()}
    assert kept == {1: passage, 2: "a b c", 3: "x  y", 4: None}


def test_automaton_spans():
    automaton = substring_dedup.SuffixAutomaton()
    automaton.add(list("abcabd"))
    automaton.add(list("xxabd"))
    assert automaton.spans(list("zabdzxabdcabd"), 3) == [(1, 4), (5, 9), (9, 13)] or automaton.spans(
        list("zabdzxabdcabd"), 3
    ) == [(1, 4), (5, 13)]
    rng = random.Random(3)
    for _ in range(60):
        refs = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.choice("abc") for _ in range(25)]
        automaton = substring_dedup.SuffixAutomaton()
        for ref in refs:
            automaton.add(ref)
        known = {tuple(r[i : i + 4]) for r in refs for i in range(len(r) - 3)}
        covered = {j for i in range(22) if tuple(text[i : i + 4]) in known for j in range(i, i + 4)}
        assert {j for s, e in automaton.spans(text, 4) for j in range(s, e)} == covered


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(pairs):
    sets = [(doc, shingles(text)) for doc, text in pairs]
    root = {doc: doc for doc, _ in pairs if doc is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return Counter((doc, len(s), None if doc is None else find(doc)) for doc, s in sets)


def near_corpus(seed):
    rng = random.Random(seed)
    out = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one three"), (None, "one two")]
    doc = 0
    for _ in range(12):
        base = [f"b{rng.randint(0, 300)}" for _ in range(rng.randint(8, 80))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
            out.append((doc, " ".join(copy)))
            doc += rng.randint(1, 3)
    chain = [f"c{i}" for i in range(60)]
    for step in range(8):  # each linked with the next only
        out.append((500 - step, " ".join(chain[step * 3 : step * 3 + 40])))
    out += [(1, out[9][1]), (950, out[9][1].upper()), out[8]]
    rng.shuffle(out)
    return list({x: None for x in out if x[0] not in (1,)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_equals_brute_force(spark, seed):
    pairs = near_corpus(seed)
    df = spark.createDataFrame(rows(pairs), SCHEMA).repartition(4)
    result = Counter(tuple(r) for r in ngram_join.near_duplicates(df).collect())
    assert result == brute_components(pairs)


def test_ngram_join_holds_one_python_worker_a_task(spark, plan, monkeypatch):
    """Two steps in Python in one task hold a worker each, and both stay for the rest of the session."""
    plans = {}
    stored = ngram_join.stored

    def noted(df, name):
        plans.setdefault(name, plan(df))
        return stored(df, name)

    monkeypatch.setattr(ngram_join, "stored", noted)
    pairs = near_corpus(1)
    result = Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA)).collect())
    assert result == brute_components(pairs)
    steps = [line.strip() for line in plans["shared"].splitlines() if re.search(r"ArrowEvalPython|MapInArrow", line)]
    assert len(steps) == 1, steps


def test_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Copies of two edits are linked only through those of one, and the smallest ids are of two."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    pairs = []
    for doc in range(160):
        copy = list(base)
        for at in rng.sample(range(10, 110, 6), 1 if doc >= 110 else 2):
            copy[at] = f"e{doc}x{at}"
        pairs.append((doc, " ".join(copy)))
    checked = []
    verified = ngram_join._verified

    def counted(found, *rest):
        checked.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    result = Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA)).collect())
    assert result == brute_components(pairs)
    assert len({r[2] for r in result}) == 1
    assert sum(checked) < 25 * len(pairs), checked


def test_prefix_length_is_safe():
    for n in range(1, 60):
        for other in range(n, 60):
            need = -(-75 * (n + other) // 175)  # smallest overlap that reaches the threshold
            if need <= n:
                assert n - need + 1 <= ngram_join.prefix_length(n, 75)
                assert other - need + 1 <= ngram_join.prefix_length(other, 75) or need > n


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 3)] + [(200, 200 + i) for i in range(1, 30)] + [(9, 9)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == 100 and {found[200 + i] for i in range(30)} == {200}


def brute_rules(text):
    w = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_host_rules(spark):
    rng = random.Random(4)
    plain = lambda k: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(k))
    pairs = [(1, None, "a"), (2, "", "a"), (3, "x " * 9, "a"), (4, plain(25) + "\n" + plain(3) + "\n\n\n x\n x", "b"),
             (5, "ü#*|\U0001f600 " * 60, "b"), (5, "ü#*|\U0001f600 " * 60, "b"), (6, plain(4000), None), (None, plain(30), "b")]
    pairs += [(100 + i, plain(30), "good") for i in range(40)] + [(200 + i, plain(30) if i < 3 else "bad", "junk") for i in range(40)]
    df = spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in pairs], "doc_id long, text string, source string, words int, host string")
    out = host_rules.judge(df).collect()
    assert len(out) == len(pairs)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text, _ in pairs:
        r = by[doc][0]
        counts = brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, doc
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
    assert all(by[100 + i][0].kept for i in range(40)) and not any(by[200 + i][0].kept for i in range(40))
    assert by[6][0].kept != by[6][0].base_failed and by[6][0].host_rate is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0
    assert host_rules.judge(empty).count() == 0


def test_word_hashes_tell_words_apart():
    text = " ".join(f"{a}{b}" for a in "abc\u00e4" for b in range(3000)).encode() + b" a  b\x0bc\n"
    words, hashes = texts.words_of(text), texts.word_hashes(text)
    assert len(words) == len(hashes) and len(set(words)) == len(set(hashes.tolist()))
    again = texts.word_hashes(b"xx " + text)[1:]
    assert (again == hashes).all()
    assert len(texts.word_hashes(None)) == len(texts.word_hashes(b" \n")) == 0


@pytest.mark.parametrize("size", [1, 2, 5, 20, 50])
def test_window_hashes(size):
    h = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    out = texts.window_hashes(h, size)
    keys = [tuple(h[i : i + size]) for i in range(len(h) - size + 1)]
    assert len(out) == len(keys)
    assert len(set(zip(keys, out.tolist()))) == len(set(keys)) == len(set(out.tolist()))
    assert len(texts.window_hashes(h[: size - 1], size)) == 0
