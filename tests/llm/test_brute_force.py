"""Operators without SQL against plain Python on small tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mutascale.llm import chat_tools, quality
from mutascale.llm.queries import TOOLS


def style(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = text.split("\n")
    n, chars = max(len(words), 1), max(len(text), 1)

    def count(characters):
        return sum(c in characters for c in text)

    return [
        count("#*$%&<>@~^=") / n, count("!?") / n, count("|") / n, sum("A" <= c <= "Z" for c in text) / chars,
        sum("0" <= c <= "9" for c in text) / chars, math.log1p(len(words)), float(len(words) < 20),
        1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), len(text) / n / 10, count(".") / n,
        sum(len(w) > 20 for w in words) / n,
    ]


def strength(groups, parents):
    """How strongly groups ``(n, x)`` are drawn to their parents, by the method of moments."""
    spread = sum(n * (x / n - p) ** 2 for (n, x), p in zip(groups, parents))
    noise = sum(p * (1 - p) for p in parents)
    between = max((spread - noise) / sum(n for n, _ in groups), 1e-6)
    return min(max(noise / len(groups) / between - 1, 1.0), 1e6)


@pytest.mark.parametrize("seed", [0, 1])
def test_quality_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pieces = ["plain words here.", "Buy NOW!!! $$$", "12 | 34\n", "\n\n", "verylongwordthatgoesonandon", "é ü", "\t", "the same the same"]
    docs = [
        (i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice(["de", "en", None]),
         rng.choice([None, ""]) if i % 20 == 7 else " ".join(rng.choices(pieces, k=rng.randint(1, 25))))
        for i in range(240)
    ]
    docs += docs[:5]
    labels = [(i, float(("Buy" in (t or "")) != (rng.random() < 0.2))) for i, _, _, t in docs[:160]]
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").repartition(6)
    known = spark.createDataFrame(labels, "doc_id long, quality double")
    rows = quality.features(frame, "doc_id", "text", "source", "lang").collect()
    texts = {d[0]: d[3] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert [r[c] for c in quality.FEATURES] == pytest.approx(style(texts[r.doc_id]))

    judged = quality.classify(frame, known).collect()
    x = np.array([style(texts[r.doc_id]) for r in judged])
    x = np.column_stack([np.ones(len(x)), x])
    seen = np.array([r.evidence for r in judged])
    weights = np.linalg.lstsq(x, seen, rcond=None)[0]
    assert x @ weights == pytest.approx(seen, abs=1e-6)  # linear in the features
    label = dict(labels)
    train = [d[0] for d in docs if d[0] in label]  # a repeated row counts each time
    z = np.array([style(texts[i]) for i in train])
    out = np.column_stack([np.ones(len(z)), z]) @ weights
    residual = np.array([label[i] for i in train]) - 1 / (1 + np.exp(-out))
    spread = z.std(0, ddof=1)
    inner = (z - z.mean(0)) / np.where(spread > 0, spread, 1)
    assert abs(residual.mean()) < 1e-3  # at the optimum of the penalised likelihood the gradient is the penalty's
    assert inner.T @ residual / len(z) == pytest.approx(1e-4 * weights[1:] * spread, abs=2e-3)

    own = {id(r): 1 / (1 + math.exp(-r.evidence)) for r in judged}
    place = {d[0]: (d[1], d[2]) for d in docs}
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for r in judged:
        for group in (paths[place[r.doc_id]], hosts[place[r.doc_id][0]]):
            group[0] += 1
            group[1] += own[id(r)]
    overall = (sum(own.values()) + 0.5) / (len(judged) + 1)
    k = strength(list(hosts.values()), [overall] * len(hosts))
    host_rate = {h: (x + k * overall) / (n + k) for h, (n, x) in hosts.items()}
    k = strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    path_rate = {p: (x + k * host_rate[p[0]]) / (n + k) for p, (n, x) in paths.items()}
    for r in judged:
        p = place[r.doc_id]
        odds = r.evidence + math.log(path_rate[p] / (1 - path_rate[p])) - math.log(overall / (1 - overall))
        assert (r.host_rate, r.path_rate, r.posterior) == pytest.approx((host_rate[p[0]], path_rate[p], 1 / (1 + math.exp(-odds))))
        assert r.kept == (r.posterior >= 0.5)


def linked(messages):
    """The rows of ``link_calls`` in plain Python, as (conv, call, position, depth, status, errors, n_results, json)."""
    first = lambda values: tuple((v is not None, v or (0 if isinstance(v, int) else "")) for v in values)  # noqa: E731  nulls first
    calls = [m for m in messages if m["kind"] == "call"]
    results = [m for m in messages if m["kind"] == "result"]
    named = lambda m: None not in (m["conv_id"], m["call_id"], m["position"])
    key = lambda m: (m["conv_id"], m["call_id"])
    fields = ["position", "name", "arguments", "depends_on"]
    holders, rest = {}, []
    for m in sorted(filter(named, calls), key=lambda m: first(m[f] for f in fields)):
        if key(m) in holders:
            rest.append((m, "duplicate"))
        else:
            holders[key(m)] = m
    rest += [(m, "unanswered") for m in calls if not named(m)]
    answers = defaultdict(list)
    for m in filter(named, results):
        answers[key(m)].append(m)

    def depth(m):
        at, seen = 0, set()
        while (m["conv_id"], m["depends_on"]) in holders:
            if key(m) in seen:
                return None
            seen.add(key(m))
            m, at = holders[m["conv_id"], m["depends_on"]], at + 1
        return at

    out = []

    def put(m, deep, status, n, content=None):
        value = chat_tools.parse(m["arguments"])
        record = {"arguments": m["arguments"] if value is None else value, "id": m["call_id"], "name": m["name"]}
        if status == "linked":
            record["result"] = content
        errors = tuple(chat_tools.problems(m["name"], m["arguments"], TOOLS))
        out.append((m["conv_id"], m["call_id"], m["position"], deep, status, errors, n, chat_tools.canonical(record)))

    for k, m in holders.items():
        deep, found = depth(m), answers[k]
        content = min(found, key=lambda r: first([*(r[f] for f in fields), r["content"]]))["content"] if found else None
        put(m, deep, "circular" if deep is None else "linked" if found else "unanswered", len(found), content)
    for m, status in rest:
        put(m, 0 if status == "unanswered" else None, status, 0)
    for m in results:
        if key(m) not in holders:
            record = chat_tools.canonical({"id": m["call_id"], "result": m["content"]})
            out.append((m["conv_id"], m["call_id"], m["position"], None, "orphan", (), 1, record))
    return Counter(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_tool_calls_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    arguments = [None, "", "{", "[]", '{"query": "x", "limit": 3}', '{"limit": 1.5, "b": 1}', '{"words": 4, "topic": "é"}']
    names = ["conv_id", "position", "kind", "call_id", "name", "arguments", "depends_on", "content"]
    rows = [
        (rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(12)]), rng.choice(["call", "call", "result", "other", None]),
         rng.choice([*"abcdefgh", None]), rng.choice(["search", "write", "?", None]), rng.choice(arguments),
         rng.choice([*"abcdefghz", None]), rng.choice(["r1", "", None]))
        for _ in range(90)
    ]
    rows += rows[:6]
    schema = "conv_id long, position long, kind string, call_id string, name string, arguments string, depends_on string, content string"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    got = Counter(
        (r.conv_id, r.call_id, r.position, r.depth, r.status, tuple(r.errors), r.n_results, r.json)
        for r in chat_tools.link_calls(frame, TOOLS).collect()
    )
    assert got == linked([dict(zip(names, row)) for row in rows])
