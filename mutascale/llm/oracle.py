"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from mutascale.llm.licenses import NOTICES, PHRASES

HOST_RULES = r"""
WITH t AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        row_number() OVER () AS rid
    FROM documents
), windows AS (
    SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) > 8)
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY rid
), base AS (
    SELECT t.rid, doc_id, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t) t
    LEFT JOIN covered USING (rid)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
    SELECT source, count(*)::HUGEINT AS n, sum(base_failed::INT)::HUGEINT AS x FROM judged WHERE source IS NOT NULL GROUP BY source
), totals AS (
    SELECT N1::DOUBLE AS N1, X1::DOUBLE AS X1, k, xx::DOUBLE / 1000000 AS xx, nn::DOUBLE AS nn, (X1::DOUBLE + 0.5) / (N1::DOUBLE + 1) AS m
    FROM (SELECT sum(n) AS N1, sum(x) AS X1, count(*) AS k, sum(x * x * 1000000 // n) AS xx, sum(n * n) AS nn FROM hosts)
), noise AS (SELECT *, m * (1 - m) AS v, N1 - nn / N1 AS scale FROM totals
), spread AS (
    SELECT *, CASE WHEN scale > 0 THEN greatest((xx - X1 * X1 / N1 - (k - 1) * v) / scale, v / 10000) ELSE v / 10000 END AS b
    FROM noise
), prior AS (SELECT m, greatest(v / least(b, v * 0.5) - 1, 1) AS s FROM spread
), rates AS (
    SELECT source, n, (x::DOUBLE + m * s) / (n::DOUBLE + s) AS rate, n::DOUBLE + s AS total FROM hosts, prior
), verdicts AS (
    SELECT source, n::BIGINT AS host_docs, rate AS host_rate,
        rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 AS host_bad FROM rates
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(host_bad, false) AS kept, source AS host, host_docs, host_rate
FROM judged LEFT JOIN verdicts USING (source)
"""

URL_FILTER = r"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS rid
    FROM pages
), rules(verdict, rule) AS (
    VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), cut AS (
    SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p FROM rules
), fits AS (
    SELECT rid, arg_max(verdict, length(h) * 1000 + length(p)) AS verdict, arg_max(rule, length(h) * 1000 + length(p)) AS rule
    FROM parts JOIN cut ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY rid
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (rid)
"""

SUBSTRING_DEDUP = r"""
WITH t AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
    FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50 AND doc_id IS NOT NULL)
), later AS (
    SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS o FROM windows) WHERE o < doc_id
), gone AS (
    SELECT DISTINCT rid, unnest(range(i, i + 50)) AS j FROM later
), words AS (
    SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM t
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY j) AS s, count(*) AS n FROM words ANTI JOIN gone USING (rid, j) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (rid)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g) GROUP BY ALL)
    JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), reached AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), smallest AS (
    SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""



def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def _turn(*parts: str) -> str:
    return _hash("'12'", *(f"({p})::VARCHAR" for p in parts))


def _bisection(rounds: int = 6, steps: int = 32) -> str:
    """Rounds of trying exponents between two bounds, each in the gap that the one before left."""
    out = "x0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"
    for i in range(rounds):
        out += f""", tried{i} AS (
    SELECT x, ln(sum(pow(p, x))) - sum(pow(p, x) * ln(p) * x) / sum(pow(p, x)) AS h, max(pow(p, x) / p) / sum(pow(p, x)) AS r
    FROM (SELECT DISTINCT lo + (hi - lo) * k / {steps} AS x FROM x{i}, range({steps} + 1) t(k)), shares GROUP BY x
), met{i} AS (
    SELECT coalesce(min(x) FILTER (WHERE h <= 0.97 * (SELECT ln(count(*)) FROM shares) + 1e-12 AND r <= 4 + 1e-12), 1.0) AS hi
    FROM tried{i}
), x{i + 1} AS (
    SELECT coalesce((SELECT max(x) FROM tried{i} WHERE x < hi), 0.0) AS lo, hi FROM met{i}
)"""
    return out


MIXING = rf"""
WITH t AS (
    SELECT doc_id, source, coalesce('=' || source, '') AS s,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n,
        {_hash("'11'", "coalesce(doc_id::VARCHAR, 'null')", "coalesce(text, 'null')")} AS k
    FROM documents
), sources AS (
    SELECT s, sum(n)::BIGINT AS tokens FROM t GROUP BY s HAVING sum(n) > 0
), shares AS (
    SELECT tokens / (SELECT sum(tokens)::DOUBLE FROM sources) AS p FROM sources
), {_bisection()}, weights AS (
    SELECT s, tokens, pow(tokens::DOUBLE, hi) / (SELECT sum(pow(tokens::DOUBLE, hi)) FROM sources, x6) AS w FROM sources, x6
), plan AS (
    SELECT s, w, q // tokens AS passes, q % tokens AS rest, ceil(tokens / 1000000)::BIGINT AS blocks
    FROM (SELECT *, round(w * (SELECT sum(tokens) FROM sources))::BIGINT AS q FROM weights)
), dealt AS (
    SELECT t.*, w, passes, rest, k % coalesce(blocks, 1) AS cell FROM t LEFT JOIN plan USING (s)
), cells AS (
    SELECT s, cell, rest, upto, upto - c AS before FROM (
        SELECT s, cell, rest, c, sum(c) OVER (PARTITION BY s ORDER BY {_turn("passes", "s", "cell")}, cell) AS upto
        FROM (SELECT s, cell, passes, rest, sum(n) AS c FROM dealt WHERE n > 0 GROUP BY ALL)
    ) WHERE upto - c < rest
), edge AS (
    SELECT s, before, rest, {_turn("passes", "k")} AS turn, k,
        sum(n) OVER (PARTITION BY s ORDER BY {_turn("passes", "k")}, k RANGE UNBOUNDED PRECEDING) AS used
    FROM dealt JOIN (SELECT s, cell, before FROM cells WHERE upto > rest) USING (s, cell) WHERE n > 0
), last AS (
    SELECT s, max((turn, k)) AS final FROM edge WHERE before + used <= rest GROUP BY s
), drawn AS (
    SELECT dealt.*, CASE WHEN n = 0 THEN 1 ELSE passes + coalesce(
        upto <= dealt.rest OR (upto IS NOT NULL AND final IS NOT NULL AND ({_turn("passes", "k")}, k) <= final), false)::INT END AS copies
    FROM dealt LEFT JOIN (SELECT s, cell, upto FROM cells) USING (s, cell) LEFT JOIN last USING (s)
), listed AS (
    SELECT *, unnest(range(copies)) AS pass FROM drawn
)
SELECT doc_id, source, n AS mix_tokens, round(w, 6) AS mix_weight, pass AS mix_pass, {_turn("pass", "s", "cell")} AS mix_block,
    {_turn("pass", "k")} AS mix_order
FROM listed
"""

_TEMPLATES = PHRASES + NOTICES


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


LICENSE_SCAN = rf"""
WITH templates(template, label, phrase, gram, size, slack) AS (
    VALUES {_values([(i, t.label, t.phrase, t.gram, len(t.words), 0 if t.phrase else 3) for i, t in enumerate(_TEMPLATES)])}
), template_words(template, pos, word) AS (
    VALUES {_values([(i, at, w) for i, t in enumerate(_TEMPLATES) for at, w in enumerate(t.words)])}
), template_grams AS (
    SELECT template, gram, pos, (SELECT string_agg(word, ' ' ORDER BY y.pos) FROM template_words y
        WHERE y.template = x.template AND y.pos >= x.pos AND y.pos < x.pos + gram) AS s
    FROM template_words x JOIN templates USING (template) WHERE pos + gram <= size
), t AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), words AS (
    SELECT rid, unnest(range(len(w))) AS place, unnest(w) AS word FROM t
), grams AS (
    SELECT rid, gram, p AS place, array_to_string(w[p + 1:p + gram], ' ') AS s
    FROM (SELECT rid, w, gram, unnest(range(len(w) - gram + 1)) AS p FROM t, (SELECT DISTINCT gram FROM templates))
), votes AS (
    SELECT rid, template, place - pos AS diagonal, count(*) AS votes FROM grams JOIN template_grams USING (gram, s) GROUP BY ALL
), steps AS (
    SELECT votes.*, slack, diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS step
    FROM votes JOIN templates USING (template)
), placed AS (
    SELECT *, sum((coalesce(step, 0) > slack)::INT) OVER (PARTITION BY rid, template ORDER BY diagonal) AS part FROM steps
), merged AS (
    SELECT rid, template, part, size, label, phrase FROM placed JOIN templates USING (template)
    GROUP BY ALL HAVING sum(votes) >= 0.3::DOUBLE * (size - any_value(gram) + 1)
), found AS (
    SELECT rid, template, part, pos, min(place) AS place
    FROM merged JOIN placed USING (rid, template, part) JOIN template_words USING (template) JOIN words USING (rid, word)
    WHERE place = diagonal + pos GROUP BY ALL
), spans AS (
    SELECT rid, template, part, label, phrase, min(place) AS first, max(place) AS last, count(*)::DOUBLE / size AS similarity
    FROM found JOIN merged USING (rid, template, part) GROUP BY rid, template, part, label, phrase, size
    HAVING count(*)::DOUBLE / size >= CASE WHEN phrase THEN 1.0 ELSE 0.8 END
), docs AS (
    SELECT rid, count(DISTINCT (first, last)) FILTER (WHERE phrase) AS n_base, min(first) FILTER (WHERE phrase) AS first_word,
        max(first) FILTER (WHERE phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(similarity) AS score
    FROM spans GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM t LEFT JOIN docs USING (rid)
"""


def _rounds(rounds: int) -> str:
    """Rounds of assigning and averaging, and a last assignment; squared distances in wide integers."""
    out = ""
    for i in range(rounds + 1):
        out += f""", near{i} AS (
    SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS d FROM v, c{i}
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)"""
        if i < rounds:
            out += f""", sums{i} AS (
    SELECT c, i, sum(z) AS s, count(*) AS n
    FROM (SELECT c, unnest(range(64)) AS i, unnest(x) AS z FROM near{i} JOIN v USING (rid)) GROUP BY c, i
), c{i + 1} AS (
    SELECT c, coalesce(m, y) AS y FROM c{i} LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM sums{i} GROUP BY c
    ) USING (c)
)"""
    return out


CENTROIDS = rf"""
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), x) - 1 AS c, x AS y FROM v WHERE vec_id IS NOT NULL
    QUALIFY c < 40
){_rounds(5)}, inertias AS (
    SELECT c, sum(d) AS s FROM near5 GROUP BY c
)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, s::BIGINT AS cluster_inertia, (SELECT sum(d) FROM near5)::BIGINT AS inertia,
    sha256(array_to_string(y, ',')) AS centroid_sha256
FROM v JOIN near5 USING (rid) JOIN c5 USING (c) JOIN inertias USING (c)
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents
    )
), f AS (
    SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM (
        SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
        FROM pieces, (VALUES (1), (2), (3)) sizes(m)
    ) GROUP BY ALL
), candidates AS (
    SELECT * FROM f WHERE m > 1 AND a >= 10
), cuts AS (
    SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM candidates)
), scored AS (
    SELECT c.lang, c.phrase, c.m, c.a, l.a AS l, r.a AS r, 1000000 * c.a * c.a // (l.a * r.a) AS score
    FROM cuts c JOIN f l ON c.lang = l.lang AND x = l.phrase JOIN f r ON c.lang = r.lang AND y = r.phrase
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM (SELECT *, string_split(phrase, ' ') AS w FROM candidates WHERE m = 3)
    ) GROUP BY ALL
), totals AS (
    SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang
)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a::BIGINT AS a,
    l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang)
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op11_license_scan": LICENSE_SCAN, "op12_centroids": CENTROIDS, "op13_collocations": COLLOCATIONS,
    "op4_mixing": MIXING,
    "op1_substring_dedup": SUBSTRING_DEDUP, "op2_ngram_join": NGRAM_JOIN,
    "op6_host_rules": HOST_RULES, "op8_url_filter": URL_FILTER,
}
