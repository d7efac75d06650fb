"""Absorbed factors against the dense fit and least squares."""

import numpy as np
import pyarrow as pa
import pytest

from mutascale.operators import absorb, anova
from mutascale.operators.anova import LinearModel

MODELS = [
    LinearModel("y", ("a",), ("x",), (("a",), ("x",))),
    LinearModel("y", ("a", "b"), ("x",), (("a",), ("b",), ("x",))),
    LinearModel("y", ("a", "b"), ("x",), (("a",), ("b",), ("a", "b"), ("x",), ("b", "x"))),
    LinearModel("y", ("a", "b"), ("x",), (("a",), ("b",), ("x",), ("a", "x"))),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 25, 900), rng.integers(0, 3, 900)
    x = rng.normal(size=900) + a * 0.1 + 50
    y = 1000 + a * 0.3 + b + 0.5 * x + 0.2 * a * (b == 2) + rng.normal(size=900)
    data = [(f"l{i:02d}", f"g{j}", float(u), float(v), "z") for i, j, u, v in zip(a, b, x, y)]
    data += [(None, "g0", 1.0, 2.0, "z"), ("l00", "g0", None, 2.0, "z"), ("lonely", "g1", 50.0, 1.0, "z")]
    return spark.createDataFrame(data, "a string, b string, x double, y double, level string").repartition(6)


@pytest.mark.parametrize("model", MODELS)
def test_absorbed_equals_dense(spark, rows, model, monkeypatch):
    dense = anova.fit(rows, model)
    monkeypatch.setattr(anova, "ABSORB_ABOVE", 5)
    wide = anova.fit(rows, model)
    assert isinstance(wide, anova.AbsorbedFit) and wide.layout.wide == "a"
    for typ in (2, 3):
        got, expected = (anova.anova_table(rows, model, typ, r).orderBy("term_order").collect() for r in (wide, dense))
        for g, e in zip(got, expected, strict=True):
            assert (g.factor, g.df, g.aliased) == (e.factor, e.df, e.aliased)
            # the dense fit works on raw products and loses digits where x is away from zero
            assert g.sum_sq == pytest.approx(e.sum_sq, rel=1e-5, abs=1e-6) and g.p_value == pytest.approx(e.p_value, abs=1e-8)
    if not any(len(t) > 1 for t in model.terms):  # without aliased columns the estimates are unique
        got, expected = ({r.coefficient: r for r in anova.coefficient_table(rows, model, r).collect()} for r in (wide, dense))
        assert set(got) == set(expected)
        for name, e in expected.items():
            assert got[name].estimate == pytest.approx(e.estimate, rel=1e-6, abs=1e-6)
            assert got[name].std_error == pytest.approx(e.std_error, rel=1e-6)
    left, right = (
        {(r.a, r.x, r.y): r.residual for r in anova.residuals(rows, fitted).collect()} for fitted in (wide, dense)
    )
    assert set(left) == set(right) and all(left[k] == pytest.approx(right[k], abs=1e-6) for k in right)
    one, other = anova.fit_statistics(rows, model, wide), anova.fit_statistics(rows, model, dense)
    assert (one.n, one.df_model) == (other.n, other.df_model) and one.r_squared == pytest.approx(other.r_squared, rel=1e-9)


def test_large_offsets_keep_their_digits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, x = rng.integers(0, 40, 800), rng.normal(size=800)
    y = a + 2 * x + rng.normal(size=800)
    model = MODELS[0]
    monkeypatch.setattr(anova, "ABSORB_ABOVE", 5)
    tables = []
    for shift in (0.0, 2.0**14):
        df = spark.createDataFrame([(int(i), float(u + shift), float(v)) for i, u, v in zip(a, np.round(x * 1024) / 1024, y)], "a int, x double, y double")
        tables.append(anova.anova_table(df, model, 2).orderBy("term_order").collect())
    for g, e in zip(*tables, strict=True):
        assert g.df == e.df and g.sum_sq == pytest.approx(e.sum_sq, rel=1e-6)


def test_many_levels(spark):
    df = spark.range(60_000).selectExpr("id % 20000 AS a", "(id * 7919) % 1009 / 100.0 AS x", "id % 20000 / 1e4 + (id * 31) % 17 AS y")
    table = {r.factor: r for r in anova.anova_table(df, MODELS[0], 2).collect()}
    assert table["a"].df == 19_999 and table["x"].df == 1 and table["Residual"].df == 60_000 - 20_001
    assert anova.coefficient_table(df, MODELS[0]).count() == 20_001


def test_levels_are_worked_on_together(monkeypatch):
    """Cells of many levels in three batches, one level over two of them: few matrix steps, the sums of each level alone."""
    rng = np.random.default_rng(4)
    levels = np.sort(rng.integers(0, 1500, 3000)).tolist()
    levels[900:1100] = [levels[900]] * 200
    layout = absorb.Layout("a", levels[0], {("x",): range(1, 2), ("b",): range(2, 3)}, 2, 0.5, 3)
    n, x, y = rng.integers(1, 9, 3000), rng.normal(size=3000) + 30, rng.normal(size=3000)
    b = rng.integers(0, 2, 3000)
    covs = [[0.3 * v, 0.1, 0.1, 0.2 * v] for v in rng.random(3000)]
    entries = [[{"column": 0, "kind": 0}, {"column": 1, "kind": 1}] + [{"column": 2, "kind": 0}] * int(i) for i in b]
    schema = pa.schema([("level", pa.int32()), ("n", pa.int64()), ("means", pa.list_(pa.float64())), ("covs", pa.list_(pa.float64())),
                        ("entries", pa.list_(pa.struct([("column", pa.int32()), ("kind", pa.int32())])))])
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip([levels, n, list(zip(x, y)), covs, entries], schema.types)], schema=schema)
    calls, moments = [], absorb.Layout.moments
    monkeypatch.setattr(absorb.Layout, "moments", lambda self, *cells: calls.append(1) or moments(self, *cells))
    variants = [frozenset(), frozenset({()}), frozenset({(), ("x",)})]
    out = [r for batch in absorb._sums(layout, variants)(iter(table.to_batches(1000))) for r in batch.to_pylist()]
    assert len(calls) < 10
    found = {(r["variant"], r["i"], r["j"]): r["value"] for r in out}
    expected = np.zeros((3, 4, 4))
    for level in sorted(set(levels)):
        gram = np.zeros((4, 4))
        for at in np.flatnonzero(np.array(levels) == level):
            z, w = np.array([1.0, x[at], b[at], y[at] - 0.5]), np.zeros((4, 4))
            w[np.ix_([1, 3], [1, 3])] = np.array(covs[at]).reshape(2, 2)
            gram += n[at] * (np.outer(z, z) + w)
        for v, own in enumerate(([], [0], [0, 1])):
            left = gram if level == levels[0] else gram - gram[:, own] @ np.linalg.pinv(gram[np.ix_(own, own)]) @ gram[own]
            expected[v] += left
    for v in range(3):
        scale = np.abs(expected[v]).max()
        got = np.array([[found.get((v, min(i, j), max(i, j)), 0.0) for j in range(4)] for i in range(4)])
        assert np.allclose(got, expected[v], atol=1e-7 * scale)
