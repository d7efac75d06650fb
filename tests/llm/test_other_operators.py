"""URL filter, nearest neighbours, packing, mixing, quality, toxicity and tool calls."""

import json
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mutascale.llm import ann, chat_tools, mixing, packing, quality, toxicity, url_filter
from mutascale.llm.queries import TOKENIZER, TOOLS, URL_RULES

PATH = public_tokenizers.path(TOKENIZER)


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/x", "http://a.example.org/es", "http://example.org/en/12/3?x=/es/",
        "https://badexample.org/es/", "http://x.com/fr/", "http://x.com/de/", "http://x.com", "http://org", "http://org/",
        "a://b.example.org#/es/", "http://example.org/en/2", "x\n://example.org/en/1\n2", "http://com/de/?q", "http://x.org:80/es/",
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, urls[3], "h", "r")], "page_id long, url string, host string, rule string")
    got = [tuple(r) for r in url_filter.judge_urls(df, URL_RULES).orderBy("page_id").collect()]
    expected = {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.org", "/es/x", "example.org/es/", "block"), 4: ("a.example.org", "/es", "org/", "allow"),
        5: ("example.org", "/en/12/3", "example.org/en/1", "block"), 6: ("badexample.org", "/es/", "org/", "allow"),
        7: ("x.com", "/fr/", "com/fr/", "allow"), 8: ("x.com", "/de/", "com/de/", "block"), 9: ("x.com", "", None, "allow"),
        10: ("org", "", None, "allow"), 11: ("org", "/", "org/", "allow"), 12: ("b.example.org", "", None, "allow"),
        13: ("example.org", "/en/2", "org/", "allow"), 14: ("example.org", "/en/1\n2", "example.org/en/1", "block"),
        15: ("com", "/de/", "com/de/", "block"), 16: ("x.org:80", "/es/", None, "allow"),
    }
    assert {r[0]: r[1:] for r in got} == expected and len(got) == len(urls) + 1
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    both = url_filter.Rules([("block", "a.b/"), ("allow", "a.b/")])
    assert both.match("x.a.b", "/") == ("block", "a.b/")


def test_url_rules_by_join(spark):
    rng = random.Random(4)
    hosts = ["a.b", "b", "x.a.b", "c.b", "B", "", "q"]
    paths = ["", "/", "/p", "/p/", "/pq/r", "/p/q", "/é/p"]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(paths)) for _ in range(40)})
    urls = [f"{rng.choice(['http', ''])}://{rng.choice(['y.', '', 'A.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?a/', '#'])}" for _ in range(400)]
    urls += [None, "", "none", "x\n://a.b/p\nq"]
    df = spark.createDataFrame([(i // 2, u, "x") for i, u in enumerate(urls)], "page_id long, url string, row string").repartition(5)
    table = spark.createDataFrame(rules, "verdict string, rule string")
    left, right = url_filter.judge_urls(df, rules), url_filter.judge_by_join(df, table)
    key = lambda r: tuple(map(str, r))
    assert left.columns == right.columns and sorted(left.collect(), key=key) == sorted(right.collect(), key=key)
    assert url_filter.judge_by_join(df.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.judge_by_join(df, table.limit(0), default="block").collect()} == {"block"}
    with pytest.raises(ValueError, match="verdict"):
        url_filter.judge_by_join(df, spark.createDataFrame([(None, "a/")], "verdict string, rule string"))


def test_url_rules_of_one_host():
    rules = url_filter.Rules([("block", f"a.b/{i:06d}") for i in range(200_000)])
    start = time.perf_counter()
    assert all(rules.match("x.a.b", f"/{i:06d}z") == ("block", f"a.b/{i:06d}") for i in range(0, 200_000, 100))
    assert time.perf_counter() - start < 1  # 2,000 urls; one by one the rules took seconds


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) + rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] * 2
    x[1000:1400] = x[100]  # one vector with many copies
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5100, [0.0] * 24, 0), (5200, [float("nan")] * 24, 0), (5300, [1.0] * 3, 0), (None, [1.0] * 24, 0)]
    odd.append((5400, [None] + [1.0] * 23, 0))
    df = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<float>, list int").repartition(7)
    result = ann.nearest(df, F.col("vec_id") % 100 == 0, part_rows=400, part_queries=8).collect()
    got = defaultdict(dict)
    for r in result:
        got[r.query_id][r["rank"]] = (r.score, r.vec_id)
    assert set(got) == set(range(0, 3000, 100))
    exact, hits = x.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-9) for s, i in found.values())
        assert list(found.values()) == [found[k] for k in sorted(found)] and [found[k] for k in range(1, 11)] == sorted(found.values())
        hits += len({i for _, i in found.values()} & set(best))
    assert hits >= 0.9 * 10 * len(got)
    assert {i for _, i in got[100].values()} == set(range(1000, 1010))  # ties: the smallest ids


def test_nearest_of_clusters_with_outliers(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 64)), 50, axis=0) + 0.02 * rng.normal(size=(3000, 64))
    x = np.concatenate([x, 3 * rng.normal(size=(60, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(set)
    for r in ann.nearest(df, (F.col("vec_id") >= 3000) | (F.col("vec_id") % 25 == 3)).collect():
        got[r.query_id].add((r["rank"], r.vec_id))
    asked = [*range(3, 3000, 25), *range(3000, 3060)]
    assert sorted(got) == asked and all({n for n, _ in got[q]} == set(range(1, 11)) for q in asked)
    true = {q: set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11]) for q in range(3, 3000, 25)}
    assert sum(len(true[q] & {i for _, i in got[q]}) for q in true) >= 0.9 * 10 * len(true)


def test_scan_leaves_k():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.normal(size=(30, 64)) * (np.arange(64) < 24)  # distances lie in the first blocks
        assert len(ann.scan(np.zeros((1, 64)), np.arange(30), x, np.eye(64), 11, 16, 0.0)[0][0]) == 11


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, pytest.approx(2**0.5))]
    assert ann.nearest(df.limit(1), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(1)
    words = ["Straße", "don't", "ÉTÉ", "a_b", "x1y2", "naïve,", "hello.", "it's", "<|endoftext|>", "(foo)", "İ", "ſ", "１２"]
    texts = [None, "", " \n", "word " * 9000] + [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(60)]
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1), (None, "null id", "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, start string, length int").repartition(6)
    pieces = packing.pack(df, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc, text, *_ in data:
        expected[doc, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (1,)] += 1
    ids_of = {doc: ids for doc, ids in expected}
    starts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = ids_of[p.doc_id]
        assert p.doc_tokens == len(ids) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        starts[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for (doc, ids), copies in expected.items():
        assert Counter(j for s, n in starts[doc] for j in range(s, s + n)) == {j: copies for j in range(len(ids))}
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_ids_of_decomposed_words():
    words = ["cafe\u0301", "nin\u0303", "A\u0308", "Cafe\u0301,", "cafe\u0301s", "x\u0301", "a\u0323\u0302!", "e!\u0301", "o=\u0338", "caf\u00e9\u2026", "end.\u201d"]
    tokenizer = Tokenizer.from_file(PATH)
    texts = [*words, " ".join(words), "cafe \u0301"]
    for text, ids in zip(texts, packing.WordIds(PATH).encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packer_bounds_its_windows():
    rng = random.Random(5)
    packer = packing.Packer(64, 4, 3)
    for i in range(500):
        list(packer.add(i, np.arange(rng.randint(1, 150), dtype=np.uint32)))
        assert len(packer.open) <= 4 and all(0 < fill < 64 for fill, _ in packer.open)


def brute_exponent(tokens, target, most):
    total = sum(tokens)
    p = np.array(tokens) / total
    for x in np.linspace(0, 1, 4001):
        w = p**x / (p**x).sum()
        if -(w * np.log(w)).sum() <= target * np.log(len(p)) + 1e-12 and (w / p).max() <= most + 1e-12:
            return x
    return 1.0


@pytest.mark.parametrize("target,most", [(0.9, 9.0), (0.99, 2.0), (1.0, 1.5), (1.0, 100.0), (0.1, 100.0)])
def test_exponent(spark, target, most):
    tokens = [100_000, 9_000, 3_000, 500, 500]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    assert mixing.exponent(df, target, most) == pytest.approx(brute_exponent(tokens, target, most), abs=5e-4)


def test_mixing_meets_its_quotas(spark):
    rng = random.Random(2)
    data = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), f"s{min(9, int(rng.expovariate(0.5)))}", 1) for i in range(2000)]
    data += [(1, data[1][1], data[1][2], 1), (5000, None, "s0", 1), (5001, " ", None, 1), (5002, "a b", None, 1), (None, "c", "s1", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, tokens int").repartition(5)
    out = mixing.mix_sources(df, block_tokens=200, target_entropy=0.97, max_epochs=3.0).collect()
    tokens, copies = Counter(), Counter()
    for _, text, source, _ in data:
        tokens[source] += len((text or "").split())
    drawn = Counter()
    passes = defaultdict(Counter)
    for r in out:
        drawn[r.source] += r.mix_tokens
        copies[r.doc_id, r.text] += 1
        passes[r.source, r.mix_pass][r.doc_id, r.text] += 1
    total = sum(tokens.values())
    weights = {r.source: r.mix_weight for r in out if r.mix_weight is not None}
    assert sum(weights.values()) == pytest.approx(1)
    for source, n in tokens.items():
        quota = round(weights[source] * total)
        assert quota - 31 <= drawn[source] <= quota and quota <= 3.01 * n
        own = Counter((d, t) for d, t, s, _ in data if s == source and (t or "").split())
        for k in range(quota // n):  # whole passes hold every document
            assert {x: c for x, c in passes[source, k].items() if (x[1] or "").split()} == own
    assert copies[5000, None] == copies[5001, " "] == 1
    again = mixing.mix_sources(df.repartition(2), block_tokens=200, target_entropy=0.97, max_epochs=3.0).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_sources(df.filter("doc_id = 5000")).count() == 1


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    rows = quality.classify(docs, train).join(test, "doc_id").select("quality", "kept").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


def test_quality_of_awkward_rows(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "x " * 50_000, "s", None), (3, "x " * 50_000, "s", None), (None, "a b", "s", "en")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, source string, lang string, evidence string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    assert quality.classify(df, labels).count() == 5  # labels of one class
    assert quality.classify(df, labels.limit(0)).filter("posterior is null").count() == 0
    assert quality.classify(df.limit(0), labels).count() == 0


def test_matcher_within_edits():
    matcher = toxicity.Matcher(["moron", "disgusting", "foo", "lowei*"])
    found = {w: matcher.match(w) for w in ("moron", "morn", "moroon", "maron", "mrn", "foo", "fooo", "disgstin", "disguting", "loweisch", "loei", "zz", "")}
    assert {w for w, f in found.items() if f} == {"moron", "morn", "moroon", "maron", "foo", "disgstin", "disguting", "loweisch", "loei"}
    assert found["moron"][0] == 0 and found["maron"][0] == 1 and found["disgstin"][0] == 2 and found["loweisch"][0] == 0


def chosen_one_by_one(counts, bad, good, precision):
    """The lexicon by comparing every item with every other."""
    rate, strong = bad / (bad + good), {}
    for item, b, g in counts:
        n = b + g
        if (b + 0.5) / (n + 1) >= precision and (b - n * rate) / (n * rate * (1 - rate)) ** 0.5 >= 6:
            strong[item] = b
    begins = []
    for item in sorted((i for i in strong if i.endswith("*")), key=lambda i: (len(i), i)):
        longest = max((b for w, b in strong.items() if not w.endswith("*") and w.startswith(item[:-1])), default=0)
        if strong[item] >= 1.3 * longest and not any(item.startswith(b[:-1]) for b in begins):
            begins.append(item)
    return sorted(begins + [w for w in strong if not w.endswith("*") and not any(w.startswith(b[:-1]) for b in begins)])


def test_lexicon_against_pairs_and_without_a_limit():
    rng = random.Random(4)
    for _ in range(20):
        counts = {}
        for _ in range(150):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(3, 11)))
            b, g = rng.randint(1, 60), rng.choice([0, 0, 1, 30])
            for item in {word, *(f"{word[:n]}*" for n in range(4, min(len(word), 10)))}:
                old = counts.get(item, (0, 0))
                counts[item] = (old[0] + b, old[1] + g)
        rows = [(item, b, g) for item, (b, g) in counts.items()]
        assert toxicity.choose_terms(rows, 900, 9000, 0.8) == chosen_one_by_one(rows, 900, 9000, 0.8)
    many = [(f"w{i}", 40, 0) for i in range(6000)]
    assert len(toxicity.choose_terms(many, 900, 9000, 0.8)) == 6000


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_matcher_equals_edit_distance():
    rng = random.Random(7)
    terms = ["".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 6, 7, 9, 10)]
    matcher = toxicity.Matcher(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(3, 11)))
        limit = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
        best = min((edits(word, t) for t in terms if edits(word, t) <= limit(t)), default=None)
        found = matcher.match(word)
        assert (found[0] if found else None) == best, (word, terms)


def test_first_letters_against_edit_distance():
    rng = random.Random(8)
    terms = ["moron", "stupid", "disgusting", "scoundrel"]
    matcher = toxicity.Matcher(terms)
    words = ["xoron", "zoron", "oron", "xmoron", "tupid", "zstupid", "qxsgusting", "sgusting", "coundrel", "xzcoundrel"]
    words += [rng.choice(["", "x", "zq", "q"]) + t[rng.randint(0, 3) :] for t in terms for _ in range(50)]
    for word in words:
        best = min((edits(word, t) for t in terms if edits(word, t) <= (1 if len(t) < 9 else 2)), default=None)
        found = matcher.match(word)
        assert (found[0] if found else None) == best, word
    assert matcher.match("zoron") and matcher.match("tupid")


def test_matches_with_digits_and_symbols():
    terms = ["moron", "stupid", "disgusting", "idiot*"]
    matcher = toxicity.Matcher(terms)

    def found(text):
        return [(terms[t], n) for t, n, _, _ in toxicity.matches(text, matcher)]

    one = {"m0ron": 0, "id1ot": 3, "st*pid": 1, "mo-ron": 0, "d1sgu$ting": 2, "id1ots": 3, "1diot": 3, "the-m0ron,": 0, "mo\u0301ron": 0}
    for text, term in one.items():
        assert [t for t, _ in found(text)] == [terms[term]] and all(n for _, n in found(text)), text
    assert found("idiot/moron") == [("idiot*", 0), ("moron", 0)] and found("a-disgusting") == [("disgusting", 0)]
    assert found("moron1 (stupid)") == [("moron", 0), ("stupid", 0)]
    assert found("m00r0n st***pid don't well-known 3d 1 m o r o n") == []
    (_, _, quoted, near), = toxicity.matches('a b "c m0ron" d e f g h', matcher)
    assert quoted and near == ["a", "b", "c", "d", "e", "f", "g"]


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(3)
    bad, plain = ["clodpole", "nitwit", "scoundrel"], [f"w{i}" for i in range(300)]
    data, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                w = rng.choice(bad)
                at = rng.randrange(1, len(w))
                words[rng.randrange(40)] = w if rng.random() < 0.7 else w[:at] + w[at + 1 :]
        data.append((i, " ".join(words), 0.5))
        labels.append((i, toxic))
    data += [(None, "nitwit", 0.1), (1000, None, 0.1), (1001, "", 0.1), (5, data[5][1], 0.1), (1002, "nitwit " * 20_000, 0.1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, known, lambda i: F.crc32(i.cast("string")) % 3 != 1).collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    none = toxicity.score(docs, known.filter("toxic = 9"), lambda i: F.lit(True))
    assert none.count() == len(data) and none.select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), known, lambda i: F.lit(True)).count() == 0


def test_tool_calls(spark):
    good, bad = '{"query":"ü","limit":2}', '{"query":1,"q":2}'
    rows = [
        ("c", 0, "call", "a", "search", good, None, None), ("c", 1, "result", "a", None, None, None, "r1"),
        ("c", 2, "call", "b", "search", bad, "a", None), ("c", 3, "call", "b", "search", good, "a", None),
        ("c", 4, "result", "a", None, None, None, "r2"), ("c", 5, "result", "z", None, None, None, "lost"),
        ("c", 6, "call", "x", "nope", None, "y", None), ("c", 7, "call", "y", "search", good, "x", None),
        ("c", 8, "call", "w", "search", '{"query":"a","query":"b"}', "x", None), ("c", 9, "call", None, "search", good, None, None),
        ("c", 10, "other", "a", None, None, None, "text"), (None, 1, "call", "a", "search", good, None, None),
    ]
    chain = [("d", i, "call", f"k{i}", "search", good, f"k{i - 1}" if i else None, None) for i in range(40)]
    df = spark.createDataFrame(
        [(*r, 0) for r in rows + chain],
        "conv_id string, position int, kind string, call_id string, name string, arguments string, depends_on string, content string, conv int",
    )
    out = chat_tools.link_calls(df, TOOLS).collect()
    by = defaultdict(list)
    for r in out:
        by[r.conv_id, r.call_id].append(r)
    first = by["c", "a"][0]
    assert (first.status, first.n_results, first.depth, first.errors) == ("linked", 2, 0, [])
    assert first.json == '{"arguments":{"limit":2,"query":"ü"},"id":"a","name":"search","result":"r1"}'
    assert sorted(r.status for r in by["c", "b"]) == ["duplicate", "unanswered"]
    held = next(r for r in by["c", "b"] if r.status == "unanswered")
    assert held.errors == ["query is no string", "unexpected q"] and held.depth == 1
    assert [r.status for r in by["c", "z"]] == ["orphan"] and json.loads(by["c", "z"][0].json)["result"] == "lost"
    assert {k: by["c", k][0].status for k in "xyw"} == dict.fromkeys("xyw", "circular")
    assert by["c", "x"][0].errors == ["unknown tool"] and by["c", "w"][0].errors == ["arguments are no object"]
    assert [by["d", f"k{i}"][0].depth for i in range(40)] == list(range(40))
    assert [r.status for r in by["c", None]] == ["unanswered"] and [r.status for r in by[None, "a"]] == ["unanswered"]
    assert len(out) == len(rows) - 3 + len(chain)
    assert chat_tools.link_calls(df.limit(0), TOOLS).count() == 0
