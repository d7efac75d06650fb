import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutascale.functions import stats
from mutascale.operators import anova
from mutascale.operators.anova import LinearModel
from mutascale.plans import effects


def design(rows, model, levels, terms):
    """Treatment-coded design columns of the given terms, with an intercept."""
    columns = [np.ones(len(rows))]
    for term in terms:
        parts = [np.ones(len(rows))]
        for name in term:
            if name in model.covariates:
                parts = [p * np.array([r[name] for r in rows], float) for p in parts]
            else:
                parts = [p * np.array([r[name] == v for r in rows], float) for p in parts for v in levels[name][1:]]
        columns += parts
    return np.column_stack(columns)


def rss(x, y):
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=1e-10)
    return float(((y - x @ beta) ** 2).sum()), rank


def expected_table(rows, model, typ):
    levels = {f: sorted({r[f] for r in rows}) for f in model.factors}
    y = np.array([r[model.response] for r in rows], float)
    terms = model.ordered_terms
    full, full_rank = rss(design(rows, model, levels, terms), y)
    out = {}
    if typ == 3:
        small, small_rank = rss(design(rows, model, levels, terms)[:, 1:], y)
        out["Intercept"] = (small - full, full_rank - small_rank)
    for term in terms:
        rest = [t for t in terms if t != term and not (typ == 2 and set(term) < set(t))]
        if typ == 2:
            small, a = rss(design(rows, model, levels, rest), y)
            large, b = rss(design(rows, model, levels, [*rest, term]), y)
        else:
            x = design(rows, model, levels, terms)
            width = {t: design(rows, model, levels, [t]).shape[1] - 1 for t in terms}
            start = 1 + sum(width[t] for t in terms[: terms.index(term)])
            small, a = rss(np.delete(x, range(start, start + width[term]), axis=1), y)
            large, b = full, full_rank
        out[":".join(term)] = (small - large, b - a)
    out["Residual"] = (full, len(rows) - full_rank)
    return out


def make_rows(seed=0, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = (str(rng.choice([f"{name}{i + 1}" for i in range(size)])) for name, size in (("a", 3), ("b", 2), ("c", 4)))
        x = float(rng.normal(50, 5))
        y = 100 + 3 * (a == "a2") - 2 * (b == "b2") + 4 * (a == "a3") * (b == "b2") + 0.3 * x + float(rng.normal())
        rows.append({"a": a, "b": b, "c": c, "x": x, "y": y})
    return rows


MODELS = [
    LinearModel("y", ("a", "b", "c"), ("x",), (("a",), ("b",), ("a", "b"), ("c",), ("x",))),
    LinearModel("y", ("a", "b"), ("x",), (("a",), ("b",), ("x",))),
    LinearModel("y", ("a", "c"), ("x",), (("a",), ("c",), ("x",), ("c", "x"))),
    LinearModel("y", (), ("x",), (("x",),)),
    LinearModel("y", ("a",), (), (("a",),)),
]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: "+".join(":".join(t) for t in m.terms))
@pytest.mark.parametrize("typ", [2, 3])
def test_sums_of_squares(spark, model, typ):
    rows = make_rows()
    df = spark.createDataFrame(rows)
    table = anova.anova_table(df, model, typ).orderBy("term_order").collect()
    expected = expected_table(rows, model, typ)
    assert [r.factor for r in table] == list(expected)
    total = sum(r.sum_sq for r in table)
    for r in table:
        assert r.sum_sq == pytest.approx(expected[r.factor][0], rel=1e-6, abs=1e-7) and r.df == expected[r.factor][1]
        assert r.eta_sq == pytest.approx(r.sum_sq / total) and not r.aliased


def test_aliased_covariate_and_empty_cell(spark):
    rows = [r for r in make_rows(2) if not (r["a"] == "a3" and r["b"] == "b2")]
    for r in rows:
        r["x"] = {"c1": 1.0, "c2": 5.0, "c3": 7.0, "c4": 0.0}[r["c"]]
    model = MODELS[0]
    table = {r.factor: r for r in anova.anova_table(spark.createDataFrame(rows), model, 2).collect()}
    for factor, (sum_sq, dof) in expected_table(rows, model, 2).items():
        assert table[factor].df == dof
        assert table[factor].sum_sq == pytest.approx(sum_sq if dof else 0.0, rel=1e-6, abs=1e-6)
    assert table["x"].aliased and table["x"].df == 0 and table["x"].F is None
    assert table["c"].aliased and table["c"].df == 2


def test_missing_rows_are_dropped(spark):
    rows = make_rows(3)
    rows[0]["y"] = rows[1]["x"] = rows[2]["a"] = None
    df = spark.createDataFrame(rows, "a string, b string, c string, x double, y double")
    residual = anova.anova_table(df, MODELS[1], 2).where("factor = 'Residual'").first()
    assert residual.df == 237 - 5


def test_coefficients_and_statistics(spark):
    rows = make_rows(4)
    df = spark.createDataFrame(rows)
    model = MODELS[1]
    levels = {f: sorted({r[f] for r in rows}) for f in model.factors}
    x, y = design(rows, model, levels, model.ordered_terms), np.array([r["y"] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    residual = y - x @ beta
    sigma2 = residual @ residual / (len(y) - x.shape[1])
    errors = np.sqrt(sigma2 * np.diag(np.linalg.inv(x.T @ x)))
    table = anova.coefficient_table(df, model).orderBy("term_order").collect()
    assert [r.coefficient for r in table] == ["Intercept", "a[a2]", "a[a3]", "b[b2]", "x"]
    for r, b, e in zip(table, beta, errors):
        assert r.estimate == pytest.approx(b, rel=1e-6) and r.std_error == pytest.approx(e, rel=1e-6)
        assert r.ci_low < r.estimate < r.ci_high
    fitted = anova.fit_statistics(df, model)
    total = ((y - y.mean()) ** 2).sum()
    assert fitted.r_squared == pytest.approx(1 - residual @ residual / total)
    n = len(y)
    likelihood = -n / 2 * (math.log(2 * math.pi * (residual @ residual) / n) + 1)
    assert fitted.log_likelihood == pytest.approx(likelihood)
    assert fitted.aic == pytest.approx(10 - 2 * likelihood) and fitted.bic == pytest.approx(5 * math.log(n) - 2 * likelihood)
    m2 = (residual**2).mean()
    assert fitted.skew == pytest.approx((residual**3).mean() / m2**1.5, abs=1e-6)
    assert fitted.kurtosis == pytest.approx((residual**4).mean() / m2**2, rel=1e-6)
    assert fitted.f_value == pytest.approx((total - residual @ residual) / 4 / sigma2)


def test_tail_probabilities():
    # Closed forms: F(1, 1), F(2, d), t(1), t(2).
    assert stats.f_tail(3.0, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(3.0)))
    for d in (2, 7, 50, 4000):
        for value in (0.1, 1.0, 5.0, 40.0):
            assert stats.f_tail(value, 2, d) == pytest.approx((1 + 2 * value / d) ** (-d / 2), rel=1e-9)
    assert stats.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert stats.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    assert stats.t_quantile(0.05, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert stats.f_tail(2.5, 3, 20) == pytest.approx(1 - _numeric_f(2.5, 3, 20), abs=1e-6)


def _numeric_f(x, a, b):
    grid = np.linspace(1e-9, x, 400001)
    log = (a / 2 * np.log(a) + b / 2 * np.log(b) + (a / 2 - 1) * np.log(grid) - (a + b) / 2 * np.log(b + a * grid)
           + math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2))
    return float(np.trapezoid(np.exp(log), grid))


def test_models_are_checked(spark):
    with pytest.raises(ValueError, match="parts"):
        LinearModel("y", ("a", "b"), (), (("a",), ("a", "b")))
    with pytest.raises(ValueError, match="unknown"):
        LinearModel("y", ("a",), (), (("z",),))
    with pytest.raises(ValueError, match="complete row"):
        anova.anova_table(spark.createDataFrame([(None, "u")], "y double, a string"), LinearModel("y", ("a",), (), (("a",),)))


@pytest.fixture(scope="module")
def observations(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        sample = ["A1", "B1", "C1", "D1", "E1", "Z9"][i % 6]
        product = f"prod{rng.integers(1, 4)}"
        group = [None, "other", "g1", "g2"][rng.integers(0, 4)]
        burden = effects.REFERENCE_BURDEN.get(sample, 50.0) * 0.9 + 2.0 * (product == "prod2") + float(rng.normal())
        rows.append((sample, f"lab{rng.integers(1, 5)}", product, group, burden))
    return spark.createDataFrame(rows, "sample string, panel_id string, product string, group string, wesTMB double")


def test_effect_family(observations):
    tables = effects.effect_tables(observations)
    counts = {(r.model, r.typ): r["count"] for r in tables.groupBy("model", "typ").count().collect()}
    assert len(counts) == 14
    assert counts["product_crossed", 2] == 6 and counts["product_crossed", 3] == 7
    assert counts["named_groups_additive", 2] == 4 and counts["group_crossed", 3] == 6
    rows = {r.factor: r for r in tables.where("model = 'named_groups_additive' and typ = 3").collect()}
    named = observations.where("group is null or group <> 'other'").where("sample <> 'Z9'")
    assert rows["Residual"].df == named.count() - (1 + 3 + 2 + 1)
    export = effects.effect_export(tables, "group_crossed")
    assert export.columns == ["factor", "F", "PR(>F)", "eta_sq"]
    assert [r.factor for r in export.collect()] == ["Intercept", "panel_id", "group", "panel_id:group", "reference wesTMB", "Residual"]


def test_both_types_agree_without_interactions(observations):
    tables = effects.effect_tables(observations)
    both = tables.where("model = 'group_additive' and factor <> 'Intercept'").groupBy("factor").agg(
        (F.max("sum_sq") - F.min("sum_sq")).alias("gap"), F.max("sum_sq").alias("size")
    )
    assert all(r.gap < 1e-6 * max(r.size, 1.0) for r in both.collect())
