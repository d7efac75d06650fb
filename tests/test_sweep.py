import math
import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutascale import session
from mutascale.plans import sweep
from mutascale.sources import readers, schemas

BASE, OPTIONAL = sweep.BASE_CLASSES, list(sweep.OPTIONAL_CLASSES.values())


def dataset(seed, slope=1.0, panels=("p1a", "p2"), samples=40):
    """Random variants; the burden follows the variant count with the given sign.

    The values are uneven so that no prediction falls on a threshold, where the last bit would decide.
    """
    rng = random.Random(seed)
    rows = []
    for s in range(samples):
        n = rng.randint(0, 9)
        burden = max(0.41, 11.83 + slope * 2.517 * n + rng.choice([-6.211, -3.307, 0.0, 3.119])) if s % 13 else 120.0
        for _ in range(n):
            kind = rng.choice([*BASE, *OPTIONAL, "Intron"])
            vaf = rng.choice([0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.4])
            rows.append((rng.choice(panels), f"s{s}", s % 3 == 0, kind, vaf, rng.random() < 0.3, burden, burden >= 10))
    return rows


SCHEMA = "panel string, sample string, is_test boolean, type string, vaf double, hot boolean, wesTMB double, rate boolean"
LENGTHS = {"p1a": 0.5, "p2": 1.25}


def naive(rows, recall, precision, classes, hotspot, cutoff, panel):
    """One scenario computed row by row."""
    kept = [r for r in rows if r[0] == panel and r[6] <= 100 and r[3] in classes and r[4] >= cutoff and not (hotspot and r[5])]
    train, test = [r for r in kept if not r[2]], [r for r in kept if r[2]]
    if not train or not test:
        return None
    mb, factor = LENGTHS[panel], 1 + (1 / recall - 1 / precision)

    def count(part):
        out = {}
        for r in part:
            out[r[1]] = out.get(r[1], 0) + 1
        return out

    n_train, n_test = count(train), count(test)
    x = np.array([n_train[r[1]] / mb for r in train])
    y = np.array([r[6] for r in train])
    coef = 0.0 if x.min() == x.max() or y.min() == y.max() else float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    intercept = float(y.mean() - coef * x.mean())
    votes = {"whfh": 0, "wlfl": 0, "whfl": 0, "wlfh": 0}
    per_sample = {}
    for r in test:
        raw = n_test[r[1]] * factor / mb * coef + intercept
        high = max(raw, 0) >= 10
        votes[("wh" if r[7] else "wl") + ("fh" if high else "fl")] += 1
        per_sample[r[1]] = (r[6], raw, max(raw, 0))
    ys, raws, fs = (np.array(v) for v in zip(*per_sample.values()))
    r2 = None if ys.min() == ys.max() else 1 - ((ys - raws) ** 2).sum() / ((ys - ys.mean()) ** 2).sum()
    rmsle = math.sqrt(((np.log1p(ys) - np.log1p(fs)) ** 2).mean())
    pairs = np.array(sorted({(y, f) for y, f in zip(ys, fs)}))
    a, b = pairs[:, 0], pairs[:, 1]
    ccc = None
    if a.min() < a.max() and b.min() < b.max():
        ccc = 2 * ((a - a.mean()) * (b - b.mean())).mean() / (a.var() + b.var() + (a.mean() - b.mean()) ** 2)
    acc = (votes["whfh"] + votes["wlfl"]) / sum(votes.values())
    return {"coef": coef, "intercept": intercept, **votes, "r2": r2, "rmsle": rmsle, "ccc": ccc, "acc": acc}


@pytest.mark.parametrize("seed,slope", [(1, 1.0), (2, -1.0), (3, 0.0)])
def test_equals_one_pass_per_scenario(spark, seed, slope):
    rows = dataset(seed, slope)
    grid = sweep.Grid(cutoffs=[0.1, 0.02], scale=[1.0, 0.7, 0.5])
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    result = sweep.sweep(spark.createDataFrame(rows, SCHEMA), lengths, grid).collect()
    found = {}
    for r in result:
        classes = [*BASE, *[name for key, name in sweep.OPTIONAL_CLASSES.items() if r[key]]]
        found[r.panel_id, r.recall, r.precision, tuple(classes), r.hotspot, r.vaf_cutoff] = r
    assert len(found) == len(result)
    lists = [[*BASE, *part] for size in range(1, 7) for part in combinations(OPTIONAL, size)]
    expected = 0
    for panel, (recall, precision), classes, hotspot, cutoff in product(
        LENGTHS, grid.accuracy_pairs(), lists, [True, False], [0.1, 0.02]
    ):
        want = naive(rows, recall, precision, classes, hotspot, cutoff, panel)
        got = found.get((panel, recall, precision, tuple(classes), hotspot, cutoff))
        assert (want is None) == (got is None)
        if want is None:
            continue
        expected += 1
        for key, value in want.items():
            if value is None:
                assert got[key] is None, key
            else:
                assert got[key] == pytest.approx(value, rel=1e-6, abs=1e-6), (key, panel, recall, precision, classes)
        assert got.exonic_size == LENGTHS[panel] and got.method == panel.rstrip("a")
    assert expected == len(result) > 500


def test_default_scenario(spark):
    rows = dataset(5)
    grid = sweep.Grid(somatic_accuracy=False, gene_content=False, hotspot_filter=False, vaf_cutoff=False)
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    result = sweep.sweep(spark.createDataFrame(rows, SCHEMA), lengths, grid).collect()
    assert len(result) == 2
    for r in result:
        want = naive(rows, 1.0, 1.0, BASE, False, 0.05, r.panel_id)
        assert r.rmsle == pytest.approx(want["rmsle"]) and not r.nonsense and r.multiplicity == 1


def test_empty_test_side_gives_no_row(spark):
    rows = [r for r in dataset(6) if not r[2]]
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    assert sweep.sweep(spark.createDataFrame(rows, SCHEMA), lengths).count() == 0


def test_grid_sizes(spark):
    pairs = sweep.Grid().accuracy_pairs()
    assert sum(pairs.values()) == 256 and len(pairs) == 30
    assert len(sweep.Grid(pairing="zip").accuracy_pairs()) == 16
    assert [sum(1 for r, p in pairs if sign(r - p)) for sign in (lambda d: d > 0, lambda d: d == 0, lambda d: d < 0)] == [15, 5, 10]
    one = spark.createDataFrame([("p",)], "panel string")
    grid = sweep.with_scenarios(one, sweep.Grid())
    assert grid.count() == 18900 and grid.agg(F.sum("multiplicity")).first()[0] == 161280
    assert sweep.with_scenarios(one, sweep.Grid(pairing="zip")).count() == 10080
    off = sweep.with_scenarios(one, sweep.Grid(False, False, False, False)).first()
    assert (off.recall, off.precision, off.classes, off.hotspot, off.vaf_cutoff) == (1.0, 1.0, BASE, False, 0.05)


def test_repeats_can_be_expanded(spark):
    rows = dataset(7)
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    grid = sweep.Grid(gene_content=False, hotspot_filter=False, vaf_cutoff=False)
    df = spark.createDataFrame(rows, SCHEMA)
    expanded = sweep.sweep(df, lengths, grid, expand=True)
    assert expanded.columns == sweep.RESULT_COLUMNS and len(sweep.RESULT_COLUMNS) == 23
    assert expanded.count() == 2 * 256


def test_stored_scenarios(spark, tmp_path):
    rows = dataset(9)
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    listed = [
        (1, 0.75, 0.95, BASE, False, 0.04), (2, 1.0, 1.0, [*BASE, "Silent"], True, 0.02),
        (3, 1.0, 1.0, [*BASE, "Silent"], True, 0.02), (4, 0.6, 0.6, [*BASE, "Nonsense_Mutation", "Silent"], False, 0.02),
    ]
    spark.createDataFrame(listed, schemas.SCENARIOS).write.parquet(str(tmp_path / "scenarios"))
    scenarios = readers.read_parquet(spark, str(tmp_path / "scenarios"))
    df = spark.createDataFrame(rows, SCHEMA)
    result = sweep.sweep_scenarios(df, lengths, scenarios)
    assert result.columns == sweep.RESULT_COLUMNS and result.count() == 2 * 3
    for _, recall, precision, classes, hotspot, cutoff in listed:
        got = result.where((F.col("recall") == recall) & (F.col("vaf_cutoff") == cutoff) & (F.col("panel_id") == "p2")).first()
        want = naive(rows, recall, precision, classes, hotspot, cutoff, "p2")
        assert got.rmsle == pytest.approx(want["rmsle"], rel=1e-6) and got.whfh == want["whfh"]
    with pytest.raises(ValueError, match="class list"):
        sweep.sweep_scenarios(df, lengths, spark.createDataFrame([(1, 1.0, 1.0, ["Silent"], False, 0.05)], schemas.SCENARIOS))


def test_hotspot_filter_drops_unknowns(spark):
    df = spark.createDataFrame(
        [(False, False, 3.0), (True, False, 3.0), (False, False, 20.0), (None, False, 3.0), (False, False, None)],
        "cancerhotspot boolean, civic boolean, cosmic96_coding double",
    )
    assert [r[0] for r in df.select(sweep.is_hot()).collect()] == [False, True, True, True, True]


def test_plan_is_shared_by_all_scenarios(spark, plan):
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    df = spark.createDataFrame(dataset(8), SCHEMA)
    text = plan(sweep.sweep(df, lengths))
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text
    single = plan(sweep.sweep(df, lengths, sweep.Grid(False, False, False, False)))
    shuffle = "Exchange hashpartitioning"
    # Cells, counters, vectors, counts, burdens, moments, and both sides of the length join: none per scenario.
    assert text.count(shuffle) == single.count(shuffle) == 8


def test_tasks_grow_with_the_input(spark, plan, tmp_path, monkeypatch):
    """The rows are dealt to more tasks than the session sets where the files are larger, with the same scores."""
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    rows = spark.createDataFrame(dataset(9), SCHEMA)
    rows.coalesce(1).write.parquet(str(tmp_path / "overlaps"))
    stored = spark.read.parquet(str(tmp_path / "overlaps"))
    grid = sweep.Grid(cutoffs=[0.1, 0.02], scale=[1.0, 0.7])
    expected = {tuple(r)[:4] + tuple(r)[4:12]: r.acc for r in sweep.sweep(rows, lengths, grid).collect()}
    monkeypatch.setattr(session, "TASK_BYTES", 64)
    width = session.shuffle_width(stored)
    assert width > 8 == session.shuffle_width(rows)
    wide = sweep.sweep(stored, lengths, grid)
    assert plan(wide).count(f", {width}), REPARTITION_BY_NUM") == 3
    assert {tuple(r)[:4] + tuple(r)[4:12]: r.acc for r in wide.collect()} == expected


def test_unknown_flags_stay_where_the_filter_is_off(spark):
    """A row without a hotspot flag is counted with the filter off and not with it on."""
    rows = [(*r[:5], None if i % 3 == 0 else r[5], *r[6:]) for i, r in enumerate(dataset(10))]
    lengths = spark.createDataFrame(list(LENGTHS.items()), "panel string, panel_mb double")
    grid = sweep.Grid(somatic_accuracy=False, gene_content=False, cutoffs=[0.02])
    found = {(r.panel_id, r.hotspot): r for r in sweep.sweep(spark.createDataFrame(rows, SCHEMA), lengths, grid).collect()}
    for (panel, hotspot), r in found.items():
        plain = [(*x[:5], True if x[5] is None else x[5], *x[6:]) for x in rows]
        want = naive(plain, 1.0, 1.0, BASE, hotspot, 0.02, panel)
        assert r.rmsle == pytest.approx(want["rmsle"], rel=1e-6) and r.whfh == want["whfh"] and r.wlfl == want["wlfl"]
    assert {h for _, h in found} == {True, False}
