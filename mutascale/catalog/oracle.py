"""The SQL twin of each registered query, over the same tables."""

from __future__ import annotations

from mutascale.catalog.bindings import (
    BURDEN_TEST,
    CLINICAL,
    INTERVALS,
    LENGTHS,
    PLACED,
    RATED,
    ROW_ID,
    SITE_TEST,
    STUDIED,
    V,
    draw,
    with_,
)
from mutascale.plans.features import VAF_CODES
from mutascale.plans.sweep import BASE_CLASSES, MAX_COSMIC, OPTIONAL_CLASSES

ID = ", ".join(ROW_ID)
ID4 = ", ".join(ROW_ID[:4])
FAILED = "regexp_matches(label, 'RF|AF')"

PROFILE = f"""
profile AS (
  SELECT sample, count(*) AS n_rows, count(*) FILTER (WHERE label LIKE '%wga%') AS n_tagged, max(vaf) AS max_vaf,
    count(*) FILTER (WHERE {FAILED}) / count(*)::DOUBLE AS failed_proportion,
    count(*) FILTER (WHERE NOT {FAILED} AND {SITE_TEST}) AS n_sites,
    count(*) FILTER (WHERE NOT {FAILED} AND {SITE_TEST} AND {BURDEN_TEST}) AS n_burden
  FROM studied GROUP BY sample
),
passed AS (
  SELECT *, CASE WHEN n_burden > 0 THEN n_burden / 0.7::DOUBLE END AS wesTMB
  FROM profile WHERE n_tagged = 0 AND max_vaf > 0.49 AND failed_proportion < 0.4
)"""

CLEAN = f"""
clean AS (
  SELECT studied.*, wesTMB, wesTMB IS NULL OR wesTMB >= 10 AS rate
  FROM studied JOIN passed USING (sample) WHERE NOT {FAILED} AND {SITE_TEST}
)"""

# Scenario sweep, written the plain way: filter and count per scenario, fit, predict, score.

_BASE = ", ".join(f"'{c}'" for c in BASE_CLASSES)
_MASK_BITS = " ".join(
    f"WHEN type = '{name}' THEN {1 << i}" for i, name in enumerate(OPTIONAL_CLASSES.values())
)
_MASK_FLAGS = ", ".join(f"mask & {1 << i} > 0 AS {name}" for i, name in enumerate(OPTIONAL_CLASSES))
_SCALE = "scale AS (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[]) AS x)"
_ADMITTED = """
admitted AS (SELECT a.x AS recall, b.x AS "precision" FROM scale a, scale b WHERE a.x > b.x OR (a.x = 1 AND b.x = 1))"""
PAIRS_PRODUCT = f"""
{_SCALE},{_ADMITTED},
pairs AS (
  SELECT a.recall, b."precision", count(*)::BIGINT AS multiplicity FROM admitted a, admitted b GROUP BY ALL
)"""
PAIRS_ZIP = f"""
{_SCALE},{_ADMITTED},
pairs AS (SELECT recall, "precision", 1::BIGINT AS multiplicity FROM admitted)"""
PAIRS_ONE = """
pairs AS (SELECT 1.0::DOUBLE AS recall, 1.0::DOUBLE AS "precision", 1::BIGINT AS multiplicity)"""


def filters(masks: str, hotspot: str, cutoffs: str) -> str:
    return f"""
filters AS (
  SELECT m.mask, h.hotspot, c.vaf_cutoff FROM (SELECT unnest({masks}) AS mask) m,
    (SELECT unnest({hotspot}) AS hotspot) h, (SELECT unnest({cutoffs}::DOUBLE[]) AS vaf_cutoff) c
)"""


FILTERS_ALL = filters("range(1, 64)", "[true, false]", "[0.01, 0.02, 0.03, 0.05, 0.1]")
FILTERS_NONE = filters("[0]", "[false]", "[0.05]")


def sweep_sql(pairs: str, chosen: str) -> str:
    return with_(V, RATED, INTERVALS, LENGTHS, PLACED, pairs, chosen) + f""",
cells AS (
  SELECT panel, sample, is_test, wesTMB, rate, vaf, hot,
    CASE WHEN type IN ({_BASE}) THEN 0 {_MASK_BITS} ELSE -1 END AS bit, count(*) AS m
  FROM placed WHERE wesTMB <= 100 GROUP BY ALL
),
counts AS (
  SELECT panel, mask, hotspot, vaf_cutoff, sample, is_test, wesTMB AS y, rate, sum(m)::BIGINT AS n
  FROM cells, filters
  WHERE bit >= 0 AND (bit = 0 OR mask & bit > 0) AND vaf >= vaf_cutoff AND NOT (hotspot AND hot)
  GROUP BY ALL
),
fits AS (
  SELECT panel, mask, hotspot, vaf_cutoff, panel_mb,
    coalesce(regr_slope(y, x), 0) AS coef, avg(y) AS mean_y, avg(x) AS mean_x
  FROM (
    -- one row per variant
    SELECT panel, mask, hotspot, vaf_cutoff, panel_mb, y, n / panel_mb AS x, unnest(range(n))
    FROM counts JOIN lengths USING (panel) WHERE NOT is_test
  ) GROUP BY ALL
),
scored AS (
  SELECT c.panel, c.mask, c.hotspot, c.vaf_cutoff, recall, "precision", multiplicity, panel_mb, coef,
    mean_y - coef * mean_x AS intercept, n, y, rate,
    n * (1 + (1 / recall - 1 / "precision")) / panel_mb * coef + (mean_y - coef * mean_x) AS p
  FROM counts c JOIN fits f ON c.panel = f.panel AND c.mask = f.mask AND c.hotspot = f.hotspot
    AND c.vaf_cutoff = f.vaf_cutoff AND c.is_test, pairs
),
plain AS (
  SELECT panel, mask, hotspot, vaf_cutoff, recall, "precision", multiplicity, panel_mb, coef, intercept,
    sum(n) FILTER (WHERE rate AND greatest(p, 0) >= 10) AS whfh,
    sum(n) FILTER (WHERE NOT rate AND NOT greatest(p, 0) >= 10) AS wlfl,
    sum(n) FILTER (WHERE rate AND NOT greatest(p, 0) >= 10) AS whfl,
    sum(n) FILTER (WHERE NOT rate AND greatest(p, 0) >= 10) AS wlfh,
    CASE WHEN min(y) < max(y) THEN 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) END AS r2,
    sqrt(avg((ln(1 + y) - ln(1 + greatest(p, 0))) * (ln(1 + y) - ln(1 + greatest(p, 0))))) AS rmsle
  FROM scored GROUP BY ALL
),
agreement AS (
  SELECT panel, mask, hotspot, vaf_cutoff, recall, "precision",
    CASE WHEN min(y) < max(y) AND min(f) < max(f)
      THEN 2 * covar_pop(y, f) / (var_pop(y) + var_pop(f) + (avg(y) - avg(f)) * (avg(y) - avg(f))) END AS ccc
  FROM (
    SELECT DISTINCT panel, mask, hotspot, vaf_cutoff, recall, "precision", greatest(p, 0) AS f, y FROM scored
  ) GROUP BY ALL
),
results AS (
  SELECT plain.* EXCLUDE (whfh, wlfl, whfl, wlfh), coalesce(whfh, 0)::BIGINT AS whfh, coalesce(wlfl, 0)::BIGINT AS wlfl,
    coalesce(whfl, 0)::BIGINT AS whfl, coalesce(wlfh, 0)::BIGINT AS wlfh, ccc
  FROM plain JOIN agreement USING (panel, mask, hotspot, vaf_cutoff, recall, "precision")
)"""


SWEEP_SELECT = f"""
SELECT panel AS panel_id, regexp_replace(panel, '[abcde]$', '') AS method, round(panel_mb, 4) AS exonic_size, recall,
  "precision", {_MASK_FLAGS}, hotspot, vaf_cutoff, round(coef, 4) AS coef, round(intercept, 4) AS intercept,
  whfh, wlfl, whfl, wlfh, round(r2, 4) AS r2, round(rmsle, 4) AS rmsle, round(ccc, 4) AS ccc,
  round((whfh + wlfl) / (whfh + wlfl + whfl + wlfh)::DOUBLE, 4) AS acc, multiplicity
FROM results
"""

# Calibration on unweighted per-sample rows.
SAMPLES = """
samples AS (
  SELECT p.panel, sample, is_test, count(*) AS n, max(wesTMB) AS wesTMB, bool_or(rate) AS rate, panel_mb,
    count(*) / panel_mb AS psTMB
  FROM placed p JOIN lengths ON p.panel = lengths.panel WHERE wesTMB <= 100 AND vaf >= 0.05
  GROUP BY p.panel, sample, is_test, panel_mb
),
sfits AS (
  SELECT panel, coalesce(regr_slope(wesTMB, psTMB), 0) AS coef,
    coalesce(regr_intercept(wesTMB, psTMB), avg(wesTMB)) AS intercept
  FROM samples WHERE NOT is_test GROUP BY panel
),
pred AS (
  SELECT s.*, psTMB * coef + intercept AS raw, greatest(psTMB * coef + intercept, 0) AS fTMB
  FROM samples s JOIN sfits USING (panel) WHERE is_test
)"""
PRED = with_(V, RATED, INTERVALS, LENGTHS, PLACED, SAMPLES)

# One factor (12 levels) and a covariate: sums of squares in closed form.
# w = within-level co-moments, s = overall, r = without an intercept (the first level keeps its raw moments).
ONE_FACTOR = """
d AS (SELECT t_alt::DOUBLE AS y, t_depth::DOUBLE AS x, type AS a FROM v),
lv AS (
  SELECT a, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS xx, count(*) * var_pop(y) AS yy,
    count(*) * covar_pop(x, y) AS xy, a = (SELECT min(a) FROM d) AS first
  FROM d GROUP BY a
),
w AS (SELECT sum(xx) AS xx, sum(yy) AS yy, sum(xy) AS xy FROM lv),
s AS (
  SELECT count(*)::DOUBLE AS n, count(*) * var_pop(x) AS xx, count(*) * var_pop(y) AS yy, count(*) * covar_pop(x, y) AS xy FROM d
),
r AS (
  SELECT sum(xx + CASE WHEN first THEN n * mx * mx ELSE 0 END) AS xx,
    sum(yy + CASE WHEN first THEN n * my * my ELSE 0 END) AS yy,
    sum(xy + CASE WHEN first THEN n * mx * my ELSE 0 END) AS xy
  FROM lv
),
rss AS (
  SELECT w.yy - w.xy * w.xy / w.xx AS full_rss, s.yy - s.xy * s.xy / s.xx AS no_factor, w.yy AS no_covariate,
    r.yy - r.xy * r.xy / r.xx AS no_intercept, s.n AS n, (SELECT count(*) FROM lv) AS levels
  FROM w, s, r
)"""


def anova_sql(intercept: bool) -> str:
    first = "SELECT 'Intercept' AS factor, no_intercept - full_rss AS sum_sq, 1 AS df, full_rss, n, levels FROM rss UNION ALL "
    return with_(V, ONE_FACTOR) + f""",
rows AS (
  {first if intercept else ''}
  SELECT 'type' AS factor, no_factor - full_rss AS sum_sq, levels - 1 AS df, full_rss, n, levels FROM rss
  UNION ALL SELECT 't_depth', no_covariate - full_rss, 1, full_rss, n, levels FROM rss
  UNION ALL SELECT 'Residual', full_rss, n - levels - 1, full_rss, n, levels FROM rss
)
SELECT factor, round(sum_sq, 4) AS sum_sq, df::BIGINT AS df,
  CASE WHEN factor <> 'Residual' THEN round(sum_sq / df / (full_rss / (n - levels - 1)), 4) END AS f_value,
  round(sum_sq / sum(sum_sq) OVER (), 4) AS eta_sq
FROM rows
"""


def _corr_sql() -> str:
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "t_alt", "hot"]
    parts = [
        f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}::INTEGER::DOUBLE, {b}), 6) AS r FROM v" if a == "hot" else
        f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) AS r FROM v"
        for i, a in enumerate(names) for b in names[:i]
    ]
    return with_(V) + " UNION ALL ".join(parts)


_VIF = with_(V) + """,
g AS (
  SELECT sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz
  FROM (SELECT l_quantity AS x, t_alt::DOUBLE AS y, hot::INTEGER::DOUBLE AS z FROM v)
),
det AS (
  SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS d FROM g
)
SELECT 'l_quantity' AS feature, round(xx * (yy * zz - yz * yz) / d, 6) AS vif FROM det
UNION ALL SELECT 't_alt', round(yy * (xx * zz - xz * xz) / d, 6) FROM det
UNION ALL SELECT 'hot', round(zz * (xx * yy - xy * xy) / d, 6) FROM det
"""

_CUTOFF_CASE = " ".join(
    f"WHEN CAST(round(l_discount * 1e6) AS BIGINT) = {int(round(k * 1e6))} THEN {v}::DOUBLE" for k, v in VAF_CODES.items()
)

_SHEET = """
sheet AS (
  SELECT 'p' || p_partkey || 'a' AS panel_id, p_partkey, 0.5::DOUBLE + p_size / 100.0::DOUBLE AS recall,
    1.0::DOUBLE - p_size / 200.0::DOUBLE AS prec, p_size, p_type, p_brand
  FROM part
),
coded AS (
  SELECT *, abs(1 / recall - 1 / prec) AS rgbrp FROM sheet
),
platforms AS (SELECT p_brand, median(rgbrp) AS platform FROM coded GROUP BY p_brand)"""


GAPS = f""",
paired AS (
  SELECT panel, wesTMB AS y, fTMB AS p FROM pred
  WHERE {draw('gap', 'sample')} % 5 <> 0 AND {draw('gap', 'sample')} % 7 <> 0
)"""
TREE_TEST = with_(V) + f""",
tested AS (SELECT * FROM v WHERE {draw('41', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} < 858993459)"""


STORED = """
listed AS (
  SELECT ([1.0, 0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[])[n_nationkey % 6 + 1] AS recall,
    ([1.0, 0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[])[n_nationkey % 4 + 1] AS "precision", (n_nationkey * 7 % 64)::INTEGER AS mask,
    n_nationkey % 2 = 0 AS hotspot, ([0.01, 0.02, 0.03, 0.05, 0.1]::DOUBLE[])[n_nationkey % 5 + 1] AS vaf_cutoff
  FROM nation
),
pairs AS (SELECT DISTINCT recall, "precision", 1::BIGINT AS multiplicity FROM listed)"""
STORED_FILTERS = """
filters AS (SELECT DISTINCT mask, hotspot, vaf_cutoff FROM listed)"""

LABEL_CELLS = """
            SELECT s.sample, l.label, count(v.label) AS n
            FROM (SELECT DISTINCT sample FROM v) s CROSS JOIN (SELECT DISTINCT label FROM v) l
            LEFT JOIN v ON v.sample = s.sample AND v.label = l.label GROUP BY ALL"""

STEP = TREE_TEST + f""",
stepped AS (
  SELECT *, t_alt::DOUBLE AS y, {draw('41', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} < 858993459 AS held_out,
    {draw('42', 'l_orderkey')} < 858993459 AS validation FROM v),
held AS (SELECT * FROM stepped WHERE held_out), checked AS (SELECT * FROM stepped WHERE NOT held_out AND validation),
means AS (SELECT hot, avg(y) AS m FROM stepped WHERE NOT held_out AND NOT validation GROUP BY hot),
whole AS (SELECT avg(y) AS overall FROM stepped WHERE NOT held_out AND NOT validation)"""


def digest(*columns: str) -> str:
    """SQL twin of ``row_digest``."""
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return "md5(" + " || ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts) + ")"


ROW_DIGEST = digest("chr", "start", "l_returnflag", "l_linestatus", "sample")
BARCODE = "printf('S-%010d-01A-11D', sample)"


def oracle() -> dict[str, str]:
    """Query name -> SQL."""
    return {
        "study_filter": with_(V, CLINICAL, STUDIED) + "SELECT sample, study, chr, start, t_depth, t_alt, label FROM studied",
        "drop_tagged_samples": with_(V) + """
            SELECT sample, chr, start, label FROM v
            WHERE NOT EXISTS (SELECT 1 FROM v t WHERE t.sample = v.sample AND t.label LIKE '%wga%')""",
        "max_vaf_samples": with_(V) + """
            SELECT sample, chr, start, round(vaf, 6) AS vaf FROM v
            WHERE sample IN (SELECT sample FROM v GROUP BY sample HAVING max(vaf) > 0.49)""",
        "label_pivot": with_(V) + "SELECT * FROM (PIVOT (SELECT sample, label FROM v) ON label USING count(*) GROUP BY sample)",
        "failed_proportion": with_(V) + f"""
            SELECT sample, count(*) AS n_rows, count(*) FILTER (WHERE {FAILED}) AS n_failed,
              round(count(*) FILTER (WHERE {FAILED}) / count(*)::DOUBLE, 6) AS failed_proportion,
              count(*) FILTER (WHERE {FAILED}) AS pivot_failed, count(*) AS pivot_rows
            FROM v GROUP BY sample""",
        "artefact_filter": with_(V) + f"""
            SELECT sample, chr, start, label FROM v WHERE NOT {FAILED} AND sample IN (
              SELECT sample FROM v GROUP BY sample HAVING count(*) FILTER (WHERE {FAILED}) / count(*)::DOUBLE < 0.4)""",
        "site_filter": with_(V) + f"""
            SELECT printf('S-%010d-01A-11D', sample) AS sample,
              substr(printf('S-%010d-01A-11D', sample), 1, 15) AS "array",
              chr, start, type, t_depth, t_alt
            FROM v WHERE {SITE_TEST}""",
        "drop_constant_cols": with_(V) + """
            SELECT l_orderkey, chr, start, label, round(vaf, 6) AS vaf, CASE WHEN vaf > 0.25 THEN 'x' END AS partly FROM v""",
        "clean_rows": with_(V, CLINICAL, STUDIED, PROFILE, CLEAN) + """
            SELECT sample, study, chr, start, type, label, round(vaf, 6) AS vaf, round(wesTMB, 6) AS wesTMB, rate
            FROM clean""",
        "sample_tmb": with_(V, CLINICAL, STUDIED, PROFILE) + """
            SELECT sample, n_rows, round(max_vaf, 6) AS max_vaf, round(failed_proportion, 6) AS failed_proportion,
              n_sites, n_burden, round(wesTMB, 6) AS wesTMB, wesTMB IS NULL OR wesTMB >= 10 AS rate FROM passed""",
        "burden_left_join": with_(V, RATED) + """
            SELECT sample, chr, start, type, round(vaf, 6) AS vaf, round(wesTMB, 6) AS wesTMB, rate FROM rated""",
        "sample_burden_table": with_(V) + f"""
            SELECT sample, count(*) AS n_burden, round(count(*) / 0.7::DOUBLE, 6) AS wesTMB FROM v
            WHERE {BURDEN_TEST} GROUP BY sample""",
        "tmb_rank_order": with_(V, RATED) + """
            SELECT sample, chr, start, type, round(vaf, 6) AS vaf, round(wesTMB, 6) AS wesTMB, row_number() OVER (
              ORDER BY rated.wesTMB NULLS FIRST, sample, chr, start, type NULLS FIRST, rated.vaf NULLS FIRST) - 1 AS position
            FROM rated""",
        "head_rows": with_(V, RATED) + """
            SELECT sample, chr, start, type, round(vaf, 6) AS vaf, round(wesTMB, 6) AS wesTMB FROM (
              SELECT * FROM rated ORDER BY rated.wesTMB NULLS FIRST, sample, chr, start, type, rated.vaf LIMIT 500)""",
        "left_lookup_purity": with_(V) + """
            SELECT printf('S-%010d-01A-11D', sample) AS sample, chr, start,
              round(c_acctbal / 10000.0::DOUBLE, 6) AS purity
            FROM v LEFT JOIN customer ON c_custkey = sample AND c_acctbal > 0""",
        "row_key_annotate": with_(V) + """,
            anno AS (
              SELECT chr, start, l_returnflag, l_linestatus, sample, max(l_tax) AS gnomad, count(*)::DOUBLE AS gnomad_raw
              FROM v WHERE l_discount > 0.05 GROUP BY ALL)
            SELECT CASE WHEN gnomad >= 0.04 THEN 'Synonymous_Mutation' ELSE type END AS type, gnomad, gnomad_raw,
              chr, start, l_returnflag, l_linestatus, sample
            FROM v LEFT JOIN anno USING (chr, start, l_returnflag, l_linestatus, sample)""",
        "row_key_collisions": with_(V) + """
            SELECT count(*) - count(DISTINCT k) AS n_collisions FROM (
              SELECT DISTINCT (chr, start, l_returnflag, l_linestatus, sample) AS k FROM v)""",
        "one_to_one_join": """
            SELECT p_partkey, p_brand, p_size, n, top_quantity FROM part LEFT JOIN (
              SELECT l_partkey, count(*)::DOUBLE AS n, max(l_quantity) AS top_quantity FROM lineitem WHERE l_quantity > 45
              GROUP BY l_partkey) ON p_partkey = l_partkey""",
        "dedupe_sample": with_(V, CLINICAL, STUDIED) + "SELECT DISTINCT sample, study FROM studied",
        "panel_size": with_(INTERVALS, LENGTHS) + "SELECT panel, round(panel_mb, 6) AS panel_mb FROM lengths",
        "interval_overlap": with_(V, INTERVALS) + f"""
            SELECT panel, {ID}, v.chr, v.start, v."end", istart, iend FROM v JOIN iv
            ON v.chr = iv.chr AND v.start < iend AND v."end" > istart""",
        "interval_overlap_counts": with_(V, INTERVALS) + """
            SELECT panel, v.chr, count(*) AS n_rows, sum(v.start)::BIGINT AS sum_start FROM v JOIN iv
            ON v.chr = iv.chr AND v.start < iend AND v."end" > istart GROUP BY panel, v.chr""",
        "panel_sample_count": with_(V, RATED, INTERVALS, LENGTHS, PLACED) + """
            SELECT p.panel, sample, type, round(vaf, 4) AS vaf, count(*) OVER (PARTITION BY p.panel, sample) AS n,
              round(count(*) OVER (PARTITION BY p.panel, sample) / panel_mb, 4) AS psTMB
            FROM placed p JOIN lengths ON p.panel = lengths.panel""",
        "systematic_sample": f"""
            WITH o AS (SELECT {ID}, row_number() OVER (ORDER BY {ID}) - 1 AS ordinal FROM lineitem),
            b AS (SELECT *, ordinal // 9 AS block FROM o)
            SELECT {ID}, ordinal::BIGINT AS ordinal, block::BIGINT AS block,
              ordinal % 9 = {draw('0', 'block')} % 9 AND block < (SELECT max(block) FROM b) AS picked
            FROM b""",
        "train_test_split": f"SELECT {ID4}, {draw('41', *ROW_ID[:4])} < 858993459 AS is_test FROM lineitem",
        "exact_test_split": f"""
            SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {draw('41', 'o_orderkey')}, o_orderkey)
              <= ceil(0.2::DOUBLE * (SELECT count(*) FROM orders)) AS is_test
            FROM orders""",
        "scenario_grid": with_(INTERVALS, PAIRS_PRODUCT, FILTERS_ALL) + f"""
            SELECT panel, recall, "precision", multiplicity, hotspot, vaf_cutoff,
              5 + bit_count(mask::INTEGER)::INTEGER AS n_classes, {_MASK_FLAGS}
            FROM (SELECT DISTINCT panel FROM iv), pairs, filters""",
        "scenario_filter_counts": with_(V, FILTERS_ALL) + f""",
            cells AS (
              SELECT CASE WHEN type IN ({_BASE}) THEN 0 {_MASK_BITS} ELSE -1 END AS bit, vaf, hot, count(*) AS m
              FROM v GROUP BY ALL)
            SELECT mask::INTEGER AS mask, hotspot, vaf_cutoff, sum(m)::BIGINT AS n_rows FROM cells, filters
            WHERE bit >= 0 AND (bit = 0 OR mask & bit > 0) AND vaf >= vaf_cutoff AND NOT (hotspot AND hot)
            GROUP BY ALL""",
        "scenario_sweep": sweep_sql(PAIRS_PRODUCT, FILTERS_ALL) + SWEEP_SELECT,
        "scenario_sweep_default": sweep_sql(PAIRS_ONE, FILTERS_NONE) + SWEEP_SELECT,
        "scenario_sweep_zip": sweep_sql(PAIRS_ZIP, filters("range(1, 64)", "[false]", "[0.05]")) + SWEEP_SELECT,
        "stored_scenarios": sweep_sql(STORED, STORED_FILTERS) + SWEEP_SELECT.replace(", multiplicity", "") + """
            WHERE (mask, hotspot, vaf_cutoff, recall, "precision") IN (
              SELECT (mask, hotspot, vaf_cutoff, recall, "precision") FROM listed)""",
        "linear_calibration": with_(V, RATED, INTERVALS, LENGTHS, PLACED) + """,
            counted AS (
              SELECT p.panel, wesTMB, count(*) OVER (PARTITION BY p.panel, sample) / panel_mb AS x
              FROM placed p JOIN lengths ON p.panel = lengths.panel WHERE wesTMB <= 100 AND vaf >= 0.05 AND NOT is_test)
            SELECT panel, round(coalesce(regr_slope(wesTMB, x), 0), 6) AS coef,
              round(coalesce(regr_intercept(wesTMB, x), avg(wesTMB)), 6) AS intercept, count(*) AS n_rows
            FROM counted GROUP BY panel""",
        "confusion_accuracy": PRED + """,
            c AS (
              SELECT panel, coalesce(sum(n) FILTER (WHERE rate AND fTMB >= 10), 0)::BIGINT AS whfh,
                coalesce(sum(n) FILTER (WHERE NOT rate AND fTMB < 10), 0)::BIGINT AS wlfl,
                coalesce(sum(n) FILTER (WHERE rate AND fTMB < 10), 0)::BIGINT AS whfl,
                coalesce(sum(n) FILTER (WHERE NOT rate AND fTMB >= 10), 0)::BIGINT AS wlfh
              FROM pred GROUP BY panel)
            SELECT *, round((whfh + wlfl) / (whfh + wlfl + whfl + wlfh)::DOUBLE, 6) AS acc FROM c""",
        "r_squared": PRED + """
            SELECT panel, round(1 - sum((wesTMB - raw) * (wesTMB - raw)) / (count(*) * var_pop(wesTMB)), 6) AS r2
            FROM pred GROUP BY panel""",
        "r_squared_gaps": PRED + GAPS + """
            SELECT panel, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2 FROM paired GROUP BY panel""",
        "concordance_gaps": PRED + GAPS + """
            SELECT panel, CASE WHEN min(y) < max(y) AND min(p) < max(p) THEN
              round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + pow(avg(y) - avg(p), 2)), 6) END AS ccc
            FROM paired GROUP BY panel""",
        "rmsle": PRED + """
            SELECT panel, round(sqrt(avg(pow(ln(1 + wesTMB) - ln(1 + fTMB), 2))), 6) AS rmsle FROM pred GROUP BY panel""",
        "rmse": PRED + "SELECT panel, round(sqrt(avg(pow(wesTMB - fTMB, 2))), 6) AS rmse FROM pred GROUP BY panel",
        "concordance": PRED + """
            SELECT panel, round(2 * covar_pop(wesTMB, fTMB)
              / (var_pop(wesTMB) + var_pop(fTMB) + pow(avg(wesTMB) - avg(fTMB), 2)), 6) AS ccc
            FROM (SELECT DISTINCT panel, wesTMB, fTMB FROM pred) GROUP BY panel""",
        "corr_matrix": _corr_sql(),
        "vif": _VIF,
        "frequency_encode": with_(V) + f"SELECT {ID4}, type, count(*) OVER (PARTITION BY type) AS type_count FROM v",
        "target_median_encode": with_(V) + f"""
            SELECT {ID4}, type, l_extendedprice, round(price, 4) AS type_price FROM v
            JOIN (SELECT type, median(l_extendedprice) AS price FROM v GROUP BY type) USING (type)""",
        "membership_flags": """
            SELECT p_partkey, p_name, contains(p_name, 'red') AS has_red, contains(p_name, 'ring') AS has_ring,
              contains(p_name, 'Red') AS has_capital_red, contains(p_name, 'old') AS has_old,
              CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END AS red_number
            FROM part""",
        "value_maps": f"""
            SELECT {ID4}, CASE {_CUTOFF_CASE} END AS cutoff_code,
              CASE l_returnflag WHEN 'A' THEN 0::DOUBLE WHEN 'N' THEN 1::DOUBLE END AS flag_code,
              l_linestatus IS DISTINCT FROM 'O' AS is_filled,
              CASE WHEN l_discount > 0.03 THEN l_discount ELSE 0.0::DOUBLE END AS decoded
            FROM lineitem""",
        "unit_scale": """
            SELECT p_partkey, p_partkey::INTEGER AS number, 'p' || p_partkey AS method,
              round(p_retailprice / p_size, 6) AS price_per_size, round(p_size / 50.0::DOUBLE, 6) AS size_50,
              round(abs(1 / (p_size / 50.0::DOUBLE) - 2.0::DOUBLE), 6) AS balance
            FROM part""",
        "prepare_features": with_(_SHEET) + """
            SELECT panel_id, p_partkey::INTEGER AS method, round((p_size * 3) / (p_size / 10.0::DOUBLE), 6) AS genes_per_mb,
              round(rgbrp, 6) AS rgbrp, count(*) OVER (PARTITION BY p_type) AS shearing, p_size % 2 = 1 AS umi,
              round((p_size * 2) / 50.0::DOUBLE, 6) AS reads, round((p_size * 10) / 100.0::DOUBLE, 6) AS depth,
              round(platform, 6) AS platform, CASE p_size % 4 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 1::DOUBLE WHEN 2 THEN 2::DOUBLE END AS genome,
              p_size % 3 = 0 AS vardict, true AS mutect2,
              CASE p_size % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE END AS cutoff, p_size % 3 = 1 AS indel,
              p_size % 2 = 0 AS known, p_size % 2 = 0 AS germline
            FROM coded JOIN platforms USING (p_brand)""",
        "anova_type2": anova_sql(False),
        "anova_type3": anova_sql(True),
        "ols_coefficients": with_(V, ONE_FACTOR) + """,
            k AS (
              SELECT w.xy / w.xx AS slope, w.xx AS wxx, full_rss / (rss.n - levels - 1) AS s2, f.my AS fy, f.mx AS fx, f.n AS fn
              FROM w, rss, (SELECT * FROM lv WHERE first) f),
            e AS (
              SELECT 't_depth' AS coefficient, slope AS estimate, sqrt(s2 / wxx) AS std_error FROM k
              UNION ALL SELECT 'Intercept', fy - slope * fx, sqrt(s2 * (1 / fn + fx * fx / wxx)) FROM k
              UNION ALL SELECT 'type[' || a || ']', (my - fy) - slope * (mx - fx),
                sqrt(s2 * (1 / lv.n + 1 / fn + (mx - fx) * (mx - fx) / wxx)) FROM k, lv WHERE NOT first)
            SELECT coefficient, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error,
              round(estimate / std_error, 4) AS t FROM e""",
        "panel_restrict": with_(V, RATED, INTERVALS, PLACED) + f"""
            SELECT panel, sample, is_test, type, round(vaf, 6) AS vaf, round(wesTMB, 6) AS wesTMB, rate, NOT coalesce(
              CASE WHEN l_returnflag <> 'N' THEN l_returnflag <> 'R' END AND NOT l_tax >= 0.07
                AND CASE WHEN l_quantity > 10 THEN t_depth ELSE 0 END < {MAX_COSMIC}, false) AS hot
            FROM placed""",
        "anova_wide": with_(V) + """,
            l AS (SELECT l_orderkey, count(*)::DOUBLE AS n, avg(t_alt) AS my, avg(t_depth) AS mx FROM v GROUP BY 1),
            d AS (SELECT t_alt - my AS y, t_depth - mx AS x FROM v JOIN l USING (l_orderkey)),
            w AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM d),
            o AS (
              SELECT count(*)::DOUBLE AS n, count(*) * (var_pop(t_alt) - pow(covar_pop(t_alt, t_depth), 2) / var_pop(t_depth)) AS no_factor
              FROM v),
            s AS (
              SELECT n, yy - xy * xy / xx AS rss, xy * xy / xx AS cov, no_factor - (yy - xy * xy / xx) AS factor,
                (SELECT count(*) FROM l) - 1 AS k FROM w, o),
            t AS (
              SELECT 'l_orderkey' AS factor, s.factor AS sum_sq, k AS df, s.factor / k / (rss / (n - k - 2)) AS f_value FROM s
              UNION ALL SELECT 't_depth', cov, 1, cov / (rss / (n - k - 2)) FROM s
              UNION ALL SELECT 'Residual', rss, (n - k - 2)::BIGINT, NULL FROM s)
            SELECT factor, round(sum_sq, 4) AS sum_sq, df::BIGINT AS df, round(f_value, 4) AS f_value,
              round(sum_sq / sum(sum_sq) OVER (), 4) AS eta_sq FROM t""",
        "anova_wide_effects": with_(V) + """,
            l AS (
              SELECT l_orderkey, count(*)::DOUBLE AS n, avg(t_alt) AS my, avg(t_depth) AS mx,
                l_orderkey = (SELECT min(l_orderkey) FROM v) AS first FROM v GROUP BY 1),
            w AS (
              SELECT sum((t_depth - mx) * (t_depth - mx)) AS xx, sum((t_depth - mx) * (t_alt - my)) AS xy,
                sum((t_alt - my) * (t_alt - my)) AS yy, count(*) - (SELECT count(*) FROM l) - 1 AS dof
              FROM v JOIN l USING (l_orderkey)),
            k AS (
              SELECT xy / xx AS slope, xx, (yy - xy * xy / xx) / dof AS s2, f.my AS fy, f.mx AS fx, f.n AS fn
              FROM w, (SELECT * FROM l WHERE first) f)
            SELECT 't_depth' AS coefficient, round(slope, 4) AS estimate, round(sqrt(s2 / xx), 4) AS std_error FROM k
            UNION ALL SELECT 'Intercept', round(fy - slope * fx, 4), round(sqrt(s2 * (1 / fn + fx * fx / xx)), 4) FROM k
            UNION ALL SELECT 'l_orderkey[' || l_orderkey || ']', round((my - fy) - slope * (mx - fx), 4),
              round(sqrt(s2 * (1 / l.n + 1 / fn + (mx - fx) * (mx - fx) / xx)), 4) FROM k, l WHERE NOT first""",
        "label_counts": with_(V) + "SELECT sample, coalesce(label, 'null') AS label, count(*) AS n FROM v GROUP BY ALL",
        "label_pivot_cells": with_(V) + LABEL_CELLS,
        "gbt_step": STEP + """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 6) AS prediction FROM held JOIN means USING (hot)""",
        "gbt_patience": STEP + """
            SELECT unnest([1, 2, 3])::INTEGER AS round, round(avg(pow(y - m, 2)), 6) AS mse, unnest([true, false, false]) AS kept
            FROM checked JOIN means USING (hot)""",
        "step_attribution": STEP + """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m - overall, 6) AS phi, round(overall, 6) AS base
            FROM held JOIN means USING (hot), whole""",
        "gbt_predict": TREE_TEST + """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t_alt::DOUBLE AS t_alt, true AS known FROM tested""",
        "tune_gbt": "SELECT unnest([0, 1, 2])::INTEGER AS trial, true AS sound",
        "tree_attribution": TREE_TEST + """
            SELECT count(*) AS n_rows, true AS adds_up, true AS pairs_add_up, f.feature, true AS finite
            FROM tested, (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'chr', 'hot']) AS feature) f
            GROUP BY f.feature""",
        "gaussian_model": with_(V) + """,
            d AS (SELECT t_alt::DOUBLE AS y, l_quantity AS x, l_discount AS z FROM v),
            m AS (
              SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, count(*) * var_pop(x) AS xx,
                count(*) * var_pop(z) AS zz, count(*) * var_pop(y) AS yy, count(*) * covar_pop(x, z) AS xz,
                count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(z, y) AS zy FROM d),
            b AS (
              SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz
              FROM m),
            s AS (SELECT *, (yy - bx * xy - bz * zy) / (n - 3) AS s2, xx * zz - xz * xz AS det FROM b)
            SELECT 'l_quantity' AS coefficient, round(bx, 4) AS estimate, round(sqrt(s2 * zz / det), 4) AS std_error FROM s
            UNION ALL SELECT 'l_discount', round(bz, 4), round(sqrt(s2 * xx / det), 4) FROM s
            UNION ALL SELECT 'Intercept', round(my - bx * mx - bz * mz, 4),
              round(sqrt(s2 * (1 / n + (mx * mx * zz + mz * mz * xx - 2 * mx * mz * xz) / det)), 4) FROM s""",
        "row_digests": with_(V) + f"SELECT {ID4}, {ROW_DIGEST} AS digest FROM v",
        "verified_annotation": with_(V) + f"""
            SELECT {ID4}, chr, start, l_returnflag, l_linestatus, sample, substr({ROW_DIGEST}, 1, 2) AS hash, "AF"
            FROM v LEFT JOIN (
              SELECT chr, start, l_returnflag, l_linestatus, sample, max(l_tax) AS "AF" FROM v WHERE l_discount > 0.05 GROUP BY ALL
            ) USING (chr, start, l_returnflag, l_linestatus, sample)""",
        "panel_files": with_(INTERVALS) + """
            SELECT 'panel' || regexp_extract(panel, '([0-9]+)$', 1) AS panel, chr::VARCHAR AS chr, istart::INTEGER AS istart,
              iend::INTEGER AS iend
            FROM iv WHERE regexp_matches(panel, '[1-4][1-5]$')""",
        "unique_panels": """
            SELECT 'panel' || p_partkey AS panel, 'p' || p_partkey || substr('abcdef', (p_size % 6 + 1)::INTEGER, 1) AS "newID"
            FROM part WHERE p_size % 6 IN (0, 5)""",
        "sheet_folder": """
            SELECT 'p' || p_partkey AS "panel ID", p_size / 50.0::DOUBLE AS recall, p_retailprice AS "precision" FROM part""",
        "typed_scan": with_(V) + f"""
            SELECT {BARCODE} AS sample, chr::VARCHAR AS panel_id, l_returnflag AS product,
              CASE WHEN hot THEN 'other' END AS "group", round(vaf, 6) AS "wesTMB" FROM v""",
        "overlap_policy": with_(V, INTERVALS) + """
            SELECT 'near' AS side, panel, count(*) AS n_rows
            FROM v JOIN iv ON v.chr = iv.chr AND v.start < iv.iend AND v."end" > iv.istart GROUP BY panel""",
        "step_importance": STEP + """
            SELECT 'hot' AS feature, round(avg(abs(m - overall)), 6) AS mean_abs_phi FROM held JOIN means USING (hot), whole""",
        "step_dependence": STEP + """
            SELECT hot::INTEGER::DOUBLE AS "value", round(m - overall, 6) AS phi, hot::INTEGER::DOUBLE AS colour, count(*) AS n
            FROM held JOIN means USING (hot), whole GROUP BY ALL""",
        "step_score": STEP + """
            SELECT count(*) AS n_rows, round(sqrt(avg(pow(y - m, 2))), 6) AS rmse FROM held JOIN means USING (hot)""",
        "publish_tables": with_(V, CLINICAL, STUDIED, PROFILE, CLEAN) + f""",
            named AS (
              SELECT chr::VARCHAR AS "Chromosome", start::INTEGER AS "Start_Position", "end"::INTEGER AS "End_Position",
                CASE WHEN hot THEN 'synonymous_variant' ELSE 'missense_variant' END AS "Consequence",
                CASE WHEN hot THEN 'Synonymous_Mutation' ELSE type END AS "Variant_Classification",
                {BARCODE} AS "Tumor_Sample_Barcode", CAST(NULL AS VARCHAR) AS purity, round(vaf, 6) AS "VAF",
                round(wesTMB, 6) AS "wesTMB", rate, {digest("chr", "start", "l_returnflag", "l_linestatus", BARCODE)} AS hash,
                CASE WHEN start % 3 = 0 THEN round((start % 100) / 1000.0::DOUBLE, 6) END AS gnomad,
                CAST(start % 7 AS VARCHAR) AS cosmic96_coding
              FROM clean)
            SELECT 'complete' AS table_name, 105 AS n_columns, * FROM named
            UNION ALL SELECT 'concise', 76, * FROM named
            UNION ALL SELECT 'minimal', 11, * REPLACE (NULL AS gnomad, NULL AS cosmic96_coding) FROM named""",
        "publish_minimal": with_(V, CLINICAL, STUDIED, PROFILE, CLEAN) + f"""
            SELECT type, sample, {ID4}, study, chr, start, round(wesTMB, 6) AS wesTMB FROM clean""",
        "results_by_panel": sweep_sql(
            PAIRS_PRODUCT, filters("[0]", "[false]", "[0.01, 0.02, 0.03, 0.05, 0.1]")
        ) + """
            SELECT panel AS panel_id, vaf_cutoff,
              count(*) AS n_scenarios, sum(whfh)::BIGINT AS whfh, round(avg(r2), 4) AS mean_r2
            FROM results GROUP BY ALL""",
    }
