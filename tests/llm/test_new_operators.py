"""License scan, centroid clustering and collocations against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mutascale.llm import centroids, collocations, licenses, texts

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- license scan


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def test_license_places(spark):
    rng = random.Random(3)
    parts = ["MIT License", "mit", "license", "Apache\nLICENSE", "general", "public", "the", "General-Public.License", "é", "mité", "KL"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " .,"), (None, "MIT License"), (5, rows[5][1]), (5, "apache license"), (103, "mit license " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, labels string").repartition(4)
    got = Counter(tuple(r)[:6] for r in licenses.scan(df, licenses.PHRASES + licenses.NOTICES).collect())
    expected = Counter()
    for doc, text in rows:
        w, places, labels = license_words(text), [], set()
        for label, phrase in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])):
            found = [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
            places += found
            labels |= {label} if found else set()
        expected[doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    assert got == expected
    assert licenses.scan(df.limit(0), licenses.PHRASES).count() == 0


def test_license_notices(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    w = notice.split()
    changed = " ".join(w[:8] + ["oddly"] + w[8:20] + w[21:])
    rows = [
        (1, f"some words {notice} and more"), (2, changed), (3, " ".join(w[:10])), (4, "in the Software without any charge to any person"),
        (5, "Licensed under the Apache Licence, Version 2.0."), (6, "licensed under the old version"), (7, f"{notice} {changed} MIT license"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.PHRASES + licenses.NOTICES).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[1].n_base == 0 and got[1].base_labels == ""
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1
    assert got[3].labels == got[4].labels == got[6].labels == "" and got[3].score == 0.0
    assert got[5].labels == "apache" and got[5].score == 7 / 8
    assert got[7].labels == got[7].base_labels == "mit" and got[7].score == 1.0


# ---- centroid clustering


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x: min((distance(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(z) // len(own) for z in zip(*own)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    total, most = sum(inertia.values()), 2**63 - 1
    fit = lambda x: x if x <= most else None
    return Counter(
        (i, j, fit(d), fit(inertia[j]), fit(total), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found
    )


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 8)) + rng.normal(size=(9, 8))[rng.integers(0, 9, 300)]) * scale
    x[40:60] = x[40]
    x[60:70] = np.round(x[60:70])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (3, x[4].tolist()), (None, x[9].tolist())]
    odd = [(900, None), (901, [1.0] * 7), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int").repartition(5)
    got = Counter(tuple(r) for r in centroids.clustered(df, k=12, dim=8).collect())
    assert got == brute_clusters(rows, 12, 5, 8)
    assert Counter(tuple(r) for r in centroids.clustered(df, k=500, dim=8, rounds=1).collect()) == brute_clusters(rows, 500, 1, 8)
    assert centroids.clustered(df.limit(0), dim=8).count() == 0
    assert centroids.clustered(df.filter("vec_id IS NULL"), dim=8).count() == 0


def test_clusters_of_huge_vectors(spark):
    rows = [(i, [float(i * 10**17), -1e30 if i == 3 else 0.5]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in centroids.clustered(df, k=3, dim=2).collect()) == brute_clusters(rows, 3, 5, 2)


def test_search_is_exact():
    rng = np.random.default_rng(1)
    for spread in (3, 40, 1000):
        c, x = rng.integers(-spread, spread, (40, 16)), rng.integers(-spread, spread, (500, 16))
        best, distance = centroids.Search(c.tolist()).assign(x)
        all_ = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == all_.argmin(1)).all() and (distance == all_.min(1)).all()


# ---- collocations


def brute_collocations(rows, min_count, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        chosen = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in chosen.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "é", "x y", "a-b", "the", "of", " z"] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(150):
        words = rng.choices(vocabulary, [9, 9, 7, 3, 2, 2, 9, 9, 2] + [1] * 30, k=rng.randint(0, 80))
        rows.append((rng.choice(["en", "en", "und", None, ""]), "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", ";;", " , "]) for w in words)))
    rows += [("en", None), ("en", ""), (None, " .\n"), ("en", rows[0][1]), ("en", rows[0][1]), ("xx", "new york " * 3000)]
    df = spark.createDataFrame([(i, l, t, 1, "p") for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, rank int, phrase string").repartition(5)
    for held, least, top in ((800_000, 4, 2000), (50, 4, 7)):
        got = collocations.collocations(df, min_count=least, held=held, top=top).collect()
        assert Counter(tuple(r) for r in got) == brute_collocations(rows, least, top)
    assert collocations.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2, 3])
def test_portions_hold_each_run_once(size):
    rng = random.Random(size)
    for _ in range(300):
        raw = "".join(rng.choice(["a", "bb", "ccc", "d" * 30, " ", " ", "\t", "\n"]) for _ in range(rng.randint(0, 120))).encode()
        runs = lambda text: Counter(run for piece in text.split(b"\n") for run in zip(*(piece.split()[i:] for i in range(size))))
        ends = lambda text: Counter(piece.split()[-1] for piece in text.split(b"\n") if piece.split())
        parts = list(collocations._portions(raw, size, 20))
        assert sum((runs(p) for p, _ in parts), Counter()) == runs(raw)
        closed = Counter()
        for p, whole in parts:
            pieces = p.split(b"\n")
            closed += sum((ends(x) for x in (pieces if whole else pieces[:-1])), Counter())
        assert closed == ends(raw)


# ---- long texts


def test_word_hashes_of_long_texts():
    rng = random.Random(1)
    words = ["x" * k for k in (1, 5, texts.BLOCK - 1, texts.BLOCK, texts.BLOCK + 1, 3 * texts.BLOCK)] + [f"w{i}" for i in range(500)]
    chosen = rng.choices(words, k=400) + rng.choices(words[6:], k=30_000)
    rng.shuffle(chosen)
    raw = "".join(w + rng.choice([" ", "\n", "  "]) for w in chosen).encode()
    hashes = texts.word_hashes(raw)
    assert len(hashes) == len(chosen)
    alone = {w: int(texts.word_hashes(w.encode())[0]) for w in set(chosen)}
    assert hashes.tolist() == [alone[w] for w in chosen] and len(set(alone.values())) == len(alone)


# ---- rows that share an id, and clashing columns


def test_an_id_with_several_texts(spark):
    from mutascale.llm import substring_dedup

    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    df = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (2, b, "z")], "doc_id long, text string, carried string")
    got = {(r.doc_id, r.carried.carried): r.n_removed for r in substring_dedup.dedup(df, carry=["carried"]).collect()}
    assert got == {(1, "x"): 0, (2, "y"): 90, (2, "z"): 0}


def test_an_id_with_many_vectors(spark):
    from pyspark.sql import functions as F

    from mutascale.llm import ann

    rows = [(0, [1.0 + i / 1000, 1.0]) for i in range(15)] + [(i, [1.0 + i, 1.0]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 11))


def test_mixing_keeps_clashing_columns(spark):
    from mutascale.llm import mixing

    rows = [(i, "w " * (i % 7 + 1), f"s{i % 2}", 7, "b", "p", "r") for i in range(40)]
    names = "doc_id long, text string, source string, count int, blocks string, passes string, rest string"
    out = mixing.mix_sources(spark.createDataFrame(rows, names))
    assert out.columns[:7] == ["doc_id", "text", "source", "count", "blocks", "passes", "rest"]
    assert {tuple(r)[3:7] for r in out.collect()} == {(7, "b", "p", "r")}
