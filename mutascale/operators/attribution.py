"""Exact Shapley attributions of a boosted-tree model, row by row and in parallel.

The values are those of path-dependent tree explanation (Lundberg et al. 2018): an unknown feature sends a row down
both branches by the share of training rows. A leaf only depends on which of the few conditions on its path a row
meets, so per leaf the attribution of every such pattern is tabulated once and rows look theirs up. Leaves with few
thresholds among them share one table with a cell for every place between the thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutascale.functions.scalar import quoted
from mutascale.operators.trees import as_model_input
from mutascale.session import scratch_path


GRID_CELLS = 4096
GRID_BYTES = 64 << 20
BATCH_VALUES = 4_000_000


@dataclass
class Leaf:
    """One leaf: its weighted value and, per feature on its path, the interval (low, high] and the cover share."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def read_leaves(model: PipelineModel, df: DataFrame) -> list[Leaf]:
    """The leaves of a fitted model. Its size is set by the number of rounds and the depth, not by the data."""
    boosted = model.stages[-1]
    spark = df.sparkSession
    path = scratch_path(spark, "trees")
    boosted.write().save(path)
    nodes: dict[int, dict[int, tuple]] = {}
    stored = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex",
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
    )
    for tree, node, *rest in stored.collect():
        nodes.setdefault(tree, {})[node] = tuple(rest)
    weights = boosted.treeWeights
    leaves: list[Leaf] = []
    for tree, by_id in nodes.items():
        todo = [(0, {})]
        while todo:
            node, path_so_far = todo.pop()
            prediction, cover, left, right, feature, threshold = by_id[node]
            if left < 0:
                items = sorted(path_so_far.items())
                leaves.append(Leaf(
                    weights[tree] * prediction, [f for f, _ in items],
                    *[[part[i] for _, part in items] for i in range(3)],
                ))
                continue
            low, high, share = path_so_far.get(feature, (-math.inf, math.inf, 1.0))
            for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
                part = by_id[child][1] / cover
                todo.append((child, {**path_so_far, feature: (*bounds, share * part)}))
    return leaves


def _pattern_gains(share: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """All 2^m patterns of met conditions (0/1) and, per pattern and feature, met minus expected."""
    m = len(share)
    met = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
    return met.astype(float), met - np.asarray(share)


def _coalition_weight(met: np.ndarray, share: list[float], players: list[int], total: int) -> np.ndarray:
    """Sum over coalitions of the players: size!(total-size-1)!/total! times met (inside) or share (outside)."""
    by_size = np.zeros((len(players) + 1, len(met)))
    by_size[0] = 1.0
    for j in players:
        grown = by_size * share[j]
        grown[1:] += by_size[:-1] * met[:, j]
        by_size = grown
    sizes = np.arange(len(players) + 1)
    weights = [math.factorial(s) * math.factorial(total - s - 1) / math.factorial(total) for s in sizes]
    return np.asarray(weights) @ by_size


def leaf_table(leaf: Leaf) -> np.ndarray:
    """Attribution per pattern and path feature."""
    met, gain = _pattern_gains(leaf.share)
    m = len(leaf.share)
    out = np.empty_like(met)
    for f in range(m):
        others = [j for j in range(m) if j != f]
        out[:, f] = leaf.value * gain[:, f] * _coalition_weight(met, leaf.share, others, m)
    return out


def leaf_pair_table(leaf: Leaf) -> np.ndarray:
    """Interaction per pattern and pair of path features, split evenly over (i, j) and (j, i); zero diagonal."""
    met, gain = _pattern_gains(leaf.share)
    m = len(leaf.share)
    out = np.zeros((len(met), m, m))
    for f in range(m):
        for g in range(f):
            others = [j for j in range(m) if j not in (f, g)]
            weight = _coalition_weight(met, leaf.share, others, m - 1)
            out[:, f, g] = out[:, g, f] = leaf.value * gain[:, f] * gain[:, g] * weight / 2.0
    return out


def merged(leaves: list[Leaf]) -> list[list[Leaf]]:
    """Leaves by the conditions on their paths: those of one group read the same patterns and share one table."""
    groups: dict[tuple, list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault((*leaf.features, *leaf.low, *leaf.high), []).append(leaf)
    return list(groups.values())


@dataclass
class Lookup:
    """A table of attributions: its features, per feature the part of the row number by bin, and the values by row."""

    features: list[int]
    digits: list[np.ndarray]
    phi: np.ndarray
    pairs: np.ndarray | None

    def rows(self, bins: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The row of the table that each input row reads."""
        at = np.zeros(n, dtype=np.int64)
        for feature, digit in zip(self.features, self.digits):
            at += digit[bins[feature]]
        return at


def all_cuts(groups: list[list[Leaf]]) -> dict[int, np.ndarray]:
    """The thresholds of every feature; a value lies in the bin that counts the thresholds below it."""
    found: dict[int, set[float]] = {}
    for leaf, *_ in groups:
        for feature, *bounds in zip(leaf.features, leaf.low, leaf.high):
            found.setdefault(feature, set()).update(b for b in bounds if math.isfinite(b))
    return {feature: np.array(sorted(cuts)) for feature, cuts in found.items()}


def blocks(groups: list[list[Leaf]], pairs: bool) -> list[list[list[Leaf]]]:
    """Groups that share a table: neighbours, while the cells between their thresholds are few.

    Beyond ``GRID_BYTES`` in all, every group is on its own and has a row per pattern of its conditions only.
    """
    out: list[list[list[Leaf]]] = []
    cuts: dict[int, set[float]] = {}
    size = spent = 0
    for group in groups:
        more = {f: cuts.get(f, set()) | set(c) for f, c in all_cuts([group]).items()}
        grown = {**cuts, **more}
        cells = math.prod(len(c) + 1 for c in grown.values())
        if out and cells <= GRID_CELLS and spent < GRID_BYTES:
            out[-1].append(group)
            cuts, size = grown, cells * 8 * len(grown) * (1 + len(grown) * pairs)
        else:
            out.append([group])
            cuts, spent, size = more, spent + size, 0
    return out


def _met(leaf: Leaf, cuts: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Per condition of a leaf, the bins that meet it."""
    tops = [np.append(cuts[f], math.inf) for f in leaf.features]
    return [(top > low) & (top <= high) for top, low, high in zip(tops, leaf.low, leaf.high)]


def lookup(block: list[list[Leaf]], cuts: dict[int, np.ndarray], interactions: bool) -> Lookup:
    """The table of a block: by the pattern of its conditions for one group, else by cell."""
    tables = [(group[0], sum(map(leaf_table, group)), sum(map(leaf_pair_table, group)) if interactions else None) for group in block]
    if len(tables) == 1:
        leaf, phi, pairs = tables[0]
        return Lookup(leaf.features, [met.astype(np.int64) << bit for bit, met in enumerate(_met(leaf, cuts))], phi, pairs)
    own = all_cuts(block)
    features, shape = sorted(own), [len(own[f]) + 1 for f in sorted(own)]
    cells, place = np.indices(shape).reshape(len(shape), -1), {f: i for i, f in enumerate(features)}
    phi = np.zeros((cells.shape[1], len(features)))
    pairs = np.zeros((*phi.shape, len(features))) if interactions else None
    for leaf, table, pair_table in tables:
        columns = [place[f] for f in leaf.features]
        pattern = np.zeros(cells.shape[1], dtype=np.int64)
        for bit, (column, met) in enumerate(zip(columns, _met(leaf, own))):
            pattern |= met[cells[column]].astype(np.int64) << bit
        phi[:, columns] += table[pattern]
        if interactions:
            pairs[np.ix_(range(len(phi)), columns, columns)] += pair_table[pattern]
    strides = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    # the bin among the cuts of the block, for every bin among those of the model
    digits = [np.searchsorted(own[f], np.append(cuts[f], math.inf)) * stride for f, stride in zip(features, strides)]
    return Lookup(features, digits, phi, pairs)


def attribute(
    model: PipelineModel,
    df: DataFrame,
    features: list[str],
    target: str,
    keys: list[str],
    interactions: bool = False,
) -> DataFrame:
    """Attributions per row: keys, the features, ``phi`` (array in feature order), base, prediction and gap.

    ``gap`` is base + sum(phi) - prediction, zero up to rounding. ``interactions`` adds a matrix whose rows sum to phi.
    """
    leaves = read_leaves(model, df)
    base = sum(leaf.value * math.prod(leaf.share) for leaf in leaves)
    groups = merged(leaves)
    shared = df.sparkSession.sparkContext.broadcast((blocks(groups, interactions), all_cuts(groups)))
    width, first = len(features), len(keys)
    step = max(1, BATCH_VALUES // (width * width if interactions else width))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cuts = shared.value
        tables = [lookup(block, cuts, interactions) for block in parts]
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                n = batch.num_rows
                bins = {f: np.searchsorted(c, batch.column(first + f).to_numpy()) for f, c in cuts.items()}
                phi, pairs = np.zeros((n, width)), np.zeros((n, width * width)) if interactions else None
                for table in tables:
                    at, own = table.rows(bins, n), table.features
                    _add(phi, own, table.phi[at])
                    if interactions:
                        _add(pairs, [f * width + g for f in own for g in own], table.pairs.reshape(len(table.pairs), -1)[at])
                total = base + phi.sum(axis=1)
                out = [_lists(phi), pa.array(np.full(n, base)), pa.array(total - batch.column(first + width).to_numpy())]
                if interactions:
                    pairs = pairs.reshape(n, width, width)
                    pairs[:, range(width), range(width)] = phi - pairs.sum(axis=2)
                    out.append(_lists(pairs))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], schema.names)

    ready = as_model_input(df, features, target)
    scored = model.transform(ready).select(*keys, *[quoted(f) for f in features], "prediction")
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *scored.schema.fields, T.StructField("phi", numbers), T.StructField("base", T.DoubleType()),
        T.StructField("gap", T.DoubleType()),
    ])
    if interactions:
        schema.add("interactions", T.ArrayType(numbers))
    return scored.mapInArrow(explain, schema)


def _add(out: np.ndarray, columns: list[int], values: np.ndarray) -> None:
    """Add to some columns, or to all in their order."""
    if columns == list(range(out.shape[1])):
        out += values
    else:
        out[:, columns] += values


def _lists(values: np.ndarray) -> pa.Array:
    """A numpy array as an Arrow column of lists, nested for every axis after the first."""
    out = pa.array(values.ravel())
    for size, rows in [(values.shape[axis], math.prod(values.shape[:axis])) for axis in range(values.ndim - 1, 0, -1)]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), out)
    return out


def mean_attribution(attributions: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    named = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.col("phi")[i])).alias("mean_abs_phi"))
        for i, f in enumerate(features)
    ])
    return attributions.agg(named.alias("rows")).select(F.inline("rows")).orderBy(F.desc("mean_abs_phi"), "feature")


def largest_gap(attributions: DataFrame) -> DataFrame:
    """Largest absolute difference between the attributions' total and the prediction."""
    return attributions.agg(F.max(F.abs("gap")).alias("max_gap"))


def dependence(attributions: DataFrame, features: list[str], feature: str, colour: str) -> DataFrame:
    """Value and attribution of one feature beside the value of another."""
    place = features.index(feature)
    return attributions.select(
        quoted(feature).alias("value"), F.col("phi")[place].alias("phi"), quoted(colour).alias("colour")
    )


def tall_attributions(attributions: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """One row per row and feature: keys, feature, value, phi. Filter on the keys to explain a single row."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), quoted(f).alias("value"), F.col("phi")[i].alias("phi"))
        for i, f in enumerate(features)
    ])
    return attributions.select(*keys, "base", F.inline(cells))
