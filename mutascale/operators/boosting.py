"""Growth of boosted regression trees on binned rows, in passes that share one table.

The rules are those of Spark ML's boosted trees: the same candidate thresholds, gain, early stop and weights, and later
trees are fitted to twice what the ones before left. Rows are kept as the bins of their features. Rows of equal bins and
label are one row with a number; a subsample draws from that number, by a hash of the content, so neither the layout of the
table nor the cluster decides. A pass sums the rows of every open node per bin; tasks add the sums and choose the splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.session import remove_path, scratch_path

BINS = 32
SAMPLE_ROWS = 10_000
STRETCH = 8  # rounds after which the scores of the rows are stored
PURE = 2.0**-52
WORD = 64
COUNTS = ("train", "valid", "held")
BLOCK = ", ".join(f"{name} binary" for name in ("bins", "label", "draw", *COUNTS, "score"))
SUMS = "trial int, node int, part int, sums binary"
CHOICE = "trial int, node int, feature int, cut int, gain double, stats array<double>"


# Draws.


def _uniform(draw: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per hash and salt."""
    z = draw + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _binomial(copies: int, rate: float) -> tuple[int, np.ndarray]:
    """The distribution function of a binomial number from its first value on; what is beyond ten deviations is left out."""
    spread = 10 * (copies * rate * (1 - rate)) ** 0.5 + 10
    low, high = max(0, int(copies * rate - spread)), min(copies, int(copies * rate + spread) + 1)
    k = np.arange(low, high, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((copies - k) / (k + 1)) + np.log(rate / (1 - rate)))])
    total = np.cumsum(np.exp(logs - logs.max()))
    return low, total / total[-1]


_small_binomial = lru_cache(maxsize=4096)(_binomial)


def drawn(draw: np.ndarray, copies: np.ndarray, rate: float, salt: int) -> np.ndarray:
    """How many of the copies of each content fall into a sample that takes every row with the chance ``rate``."""
    if rate >= 1:
        return copies
    u = _uniform(draw, salt)
    out = (u < rate) * copies
    many = np.flatnonzero(copies > 1)
    if len(many) and rate > 0:
        many = many[np.argsort(copies[many], kind="stable")]
        sizes, starts = np.unique(copies[many], return_index=True)
        for size, rows in zip(sizes.tolist(), np.split(many, starts[1:])):
            low, total = (_small_binomial if size <= WORD * WORD else _binomial)(size, rate)
            out[rows] = low + np.searchsorted(total, u[rows])
    return out


# Candidate thresholds.


def thresholds(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds: between all neighbouring values, or where the counted rows pass equal shares."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, weights=counts)
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    stride = counts.sum() / (most + 1)
    found, target, before = [], stride, counts[0]
    for middle, count in zip(between.tolist(), counts[1:].tolist()):
        if abs(before - target) < abs(before + count - target):
            found.append(middle)
            target += stride
        before += count
    return np.array(found[:most])


def _parts(batch: pa.RecordBatch, share: float) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Hashes and copies of counted rows, and the copies for growing, for the early stop and for the error."""
    draw = batch.column("draw").to_numpy().view(np.uint64)
    copies = batch.column("copies").to_numpy().astype(np.int64)
    inside = drawn(draw, copies, share, -1)
    flag = batch.column("flag").to_numpy(zero_copy_only=False).astype(bool)
    return draw, copies, {"train": inside * ~flag, "valid": inside * flag, "held": copies - inside}


def _sampled(counted: DataFrame, width: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Features and numbers of a sample of the rows that trees grow on; all of them where they are few."""
    n = (counted.where("NOT flag").agg(F.sum("copies")).first()[0] or 0) * share
    names, rate = [f"f{i}" for i in range(width)], min(1.0, max(BINS * BINS, SAMPLE_ROWS) / max(n, 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw, _, parts = _parts(batch, share)
            taken = drawn(draw, parts["train"], rate, -2)
            kept = pa.array(taken > 0)
            columns = [batch.column(name).filter(kept) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken[taken > 0])], [*names, "copies"])

    schema = ", ".join([*(f"{name} double" for name in names), "copies long"])
    rows = counted.mapInArrow(pick, schema).toArrow()
    table = [rows.column(name).to_numpy() for name in names]
    return np.array(table).reshape(width, len(rows)), rows.column("copies").to_numpy()


# The table of binned rows.


class Binned:
    """Binned rows in blocks below the scratch folder: bins, label, hash, numbers of copies and scores per trial."""

    def __init__(self, counted: DataFrame, width: int, share: float = 1.0):
        """``counted`` has f0, f1, ..., label, flag (rows of the early stop) and copies; ``share`` of the copies are fitted."""
        self.spark, self.width = counted.sparkSession, width
        counted = counted.withColumn("draw", F.xxhash64(*[f"f{i}" for i in range(width)], "label", "flag"))
        values, counts = _sampled(counted, width, share)
        if not counts.sum():
            raise ValueError("no rows to fit")
        most = min(BINS, int(counts.sum())) - 1
        self.cuts = cuts = [thresholds(row, counts, most) for row in values]

        def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, parts = _parts(batch, share)
                bins = np.empty((batch.num_rows, width), dtype=np.uint8)
                for i, cut in enumerate(cuts):
                    bins[:, i] = np.searchsorted(cut, batch.column(f"f{i}").to_numpy())
                ends = pa.py_buffer(np.arange(0, bins.size + 1, width, dtype=np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, ends, pa.py_buffer(bins)])
                arrays = [packed, batch.column("label"), *(pa.array(parts[name]) for name in COUNTS)]
                yield pa.RecordBatch.from_arrays(arrays, ["bins", "label", *COUNTS])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
                    rest = [batch.column(name).to_numpy().tobytes() for name in ("label", "draw", *COUNTS)]
                    yield _row([np.ascontiguousarray(bins.T).tobytes(), *rest, b""])

        binned = counted.mapInArrow(bin_, "bins binary, label double, train long, valid long, held long")
        merged = binned.groupBy("bins", "label").agg(*[F.sum(name).alias(name) for name in COUNTS])
        self.path = self.base = self._write(merged.withColumn("draw", F.xxhash64("bins", "label")).mapInArrow(block, BLOCK))

    def _write(self, blocks: DataFrame) -> str:
        path = scratch_path(self.spark, "binned")
        blocks.write.option("parquet.block.size", 8 << 20).parquet(path)
        return path

    def __enter__(self) -> Binned:
        return self

    def __exit__(self, *_) -> None:
        self.forget()
        remove_path(self.spark, self.base)

    def forget(self) -> None:
        """Remove the stored scores."""
        if self.path != self.base:
            remove_path(self.spark, self.path)
            self.path = self.base

    def summed(self, steps: list[Step]) -> list:
        """One pass: the choice of every open node of the steps, and under node -1 the squared errors."""
        cuts, least = [len(c) for c in self.cuts], {s.trial: (s.least_rows, s.least_gain) for s in steps}
        width = self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for rows in _blocks(batches, width):
                for step in steps:
                    step.add(rows, sums)
            part, keys = TaskContext.get().partitionId(), list(sums)
            columns = [[t for t, _ in keys], [n for _, n in keys], [part] * len(keys), [sums[k].tobytes() for k in keys]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["trial", "node", "part", "sums"]
            )

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(s) for s in frame.sort_values("part")["sums"])  # in one order: rounding is the same
            trial, node = int(frame["trial"].iloc[0]), int(frame["node"].iloc[0])
            found = (-1, -1, 0.0, total) if node < 0 else best_split(total.reshape(width, BINS, 3), cuts, *least[trial])
            return pd.DataFrame([(trial, node, *found[:3], list(found[3]))], columns=["trial", "node", "feature", "cut", "gain", "stats"])

        blocks = self.spark.read.schema(BLOCK).parquet(self.path)
        return blocks.mapInArrow(add, SUMS).groupBy("trial", "node").applyInPandas(choose, CHOICE).collect()

    def store(self, trials: int, routes: dict[int, list[Route]]) -> None:
        """Add the trees of each trial to the stored scores of the rows."""
        width = self.width

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _blocks(batches, width):
                scores = np.zeros((trials, len(rows.label)))
                for trial in range(trials):
                    scores[trial] = rows.scored(trial, routes.get(trial, []))
                yield _row([*map(bytes, rows.stored), scores.tobytes()])

        scored = self._write(self.spark.read.schema(BLOCK).parquet(self.path).mapInArrow(score, BLOCK))
        self.forget()
        self.path = scored


def _row(values: list) -> pa.RecordBatch:
    names = [item.split()[0] for item in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names)


class Rows:
    """The rows of one block."""

    def __init__(self, stored: list, score, width: int):
        self.stored = stored
        self.bins = np.frombuffer(stored[0], np.uint8).reshape(width, -1)
        self.label = np.frombuffer(stored[1])
        self.draw = np.frombuffer(stored[2], np.uint64)
        self.train, self.valid, self.held = (np.frombuffer(s, np.int64) for s in stored[3:])
        self.score = np.frombuffer(score).reshape(-1, len(self.label))

    def scored(self, trial: int, routes: list[Route]) -> np.ndarray:
        """The score of a trial: what was stored and the trees since."""
        out = self.score[trial].copy() if trial < len(self.score) else np.zeros(len(self.label))
        for route in routes:
            out += route.values[route.reached(self.bins)]
        return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    for batch in batches:
        for i in range(batch.num_rows):
            cells = [column[i].as_buffer() for column in batch.columns]
            yield Rows(cells[:-1], cells[-1], width)


# Trees.


@dataclass
class Node:
    """A node, its sums (rows, targets, squared targets) and its split; rows with bin <= cut go left."""

    sums: np.ndarray
    feature: int = -1
    cut: int = -1
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def prediction(self) -> float:
        return float(self.sums[1] / self.sums[0]) if self.sums[0] else 0.0

    @property
    def impurity(self) -> float:
        return float((self.sums[2] - self.sums[1] ** 2 / self.sums[0]) / self.sums[0]) if self.sums[0] else 0.0


def best_split(sums: np.ndarray, cuts: list[int], least_rows: int, least_gain: float) -> tuple[int, int, float, np.ndarray]:
    """Feature, cut and gain (fall of the variance) of the best split of a node, and the sums of the node and both sides.

    The first of equal gains wins. A split that leaves a side fewer than ``least_rows``, or gains less than ``least_gain``
    or nothing, is none; feature and cut are then -1.
    """
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    allowed = np.arange(left.shape[1]) < np.array(cuts)[:, None]
    allowed &= (left[..., 0] >= max(least_rows, 1)) & (right[..., 0] >= max(least_rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[..., 1] ** 2 / whole[..., 0]
        gain = np.where(allowed, fall / whole[..., 0], -np.inf)
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    best = float(gain[feature, cut])
    if not (best > 0 and best >= least_gain):
        return -1, -1, 0.0, whole[0, 0]
    return int(feature), int(cut), best, np.concatenate([whole[feature, 0], left[feature, cut], right[feature, cut]])


class Route:
    """Which leaf of a tree a row reaches: per feature and bin the leaves that are still open, as bits."""

    def __init__(self, root: Node, value: Callable[[Node], float]):
        leaves, todo = [], [(root, {})]
        while todo:
            node, path = todo.pop()
            if node.left is None:
                leaves.append((node, path))
                continue
            low, high = path.get(node.feature, (0, BINS))
            todo.append((node.right, {**path, node.feature: (max(low, node.cut + 1), high)}))
            todo.append((node.left, {**path, node.feature: (low, min(high, node.cut + 1))}))
        self.values = np.array([value(node) for node, _ in leaves])
        self.features = sorted({f for _, path in leaves for f in path})
        self.open = np.zeros((-(-len(leaves) // WORD), len(self.features), BINS), dtype=np.uint64)
        for at, (_, path) in enumerate(leaves):
            for i, f in enumerate(self.features):
                low, high = path.get(f, (0, BINS))
                self.open[at // WORD, i, low:high] |= np.uint64(1 << at % WORD)

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The place of the leaf of each row; exactly one bit of all words is left."""
        out = np.zeros(bins.shape[1], dtype=np.int64)
        for word, masks in enumerate(self.open if self.features else []):
            left = masks[0][bins[self.features[0]]]
            for mask, f in zip(masks[1:], self.features[1:]):
                left &= mask[bins[f]]
            place = (left.astype(float).view(np.int64) >> 52) - 1023 + word * WORD  # the exponent of a power of two
            out = place if len(self.open) == 1 else np.where(left != 0, place, out)
        return out


@dataclass
class Step:
    """What a pass does for one trial: errors of the ensemble so far, and the sums of the open nodes of the tree."""

    trial: int
    routes: list[Route]  # the trees since scores were stored
    front: Route | None  # the tree that grows; its values are the places of open nodes, -1 elsewhere
    n_open: int
    later: bool  # whether trees went before
    rate: float
    salt: int
    least_rows: int
    least_gain: float
    check: bool

    def add(self, rows: Rows, sums: dict[tuple[int, int], np.ndarray]) -> None:
        score = rows.scored(self.trial, self.routes)
        if self.check:
            off = (rows.label - score) ** 2
            errors = np.array([rows.valid @ off, rows.valid.sum(), rows.held @ off, rows.held.sum()], dtype=float)
            sums[self.trial, -1] = sums.get((self.trial, -1), 0.0) + errors
        if not self.n_open:
            return
        taken = drawn(rows.draw, rows.train, self.rate, self.salt).astype(float)
        place = self.front.values[self.front.reached(rows.bins)]
        bins, target = rows.bins, (rows.label - score) * 2 if self.later else rows.label
        used = (taken > 0) & (place >= 0)
        if not used.all():
            bins, target, taken, place = bins[:, used], target[used], taken[used], place[used]
        first, second = taken * target, taken * target * target
        found = np.empty((self.n_open, len(bins), BINS, 3))
        for i, row in enumerate(bins):
            at = place * BINS + row
            for k, weights in enumerate((taken, first, second)):
                found[:, i, :, k] = np.bincount(at, weights, self.n_open * BINS).reshape(self.n_open, BINS)
        for node in range(self.n_open):
            key = self.trial, node
            sums[key] = sums[key] + found[node].ravel() if key in sums else found[node].ravel()


# Boosting.


@dataclass
class Grower:
    """One ensemble: its parameters and what has grown."""

    eta: float
    max_depth: int
    subsample: float
    least_rows: int
    least_gain: float
    trees: list[Node] = field(default_factory=list)
    valid: list[float] = field(default_factory=list)  # mean squared error of every prefix
    held: list[float] = field(default_factory=list)
    best: int = 0
    done: bool = False

    def weight(self, at: int) -> float:
        return self.eta if at else 1.0


def lasting(errors: list[float], tolerance: float = 0.01) -> tuple[int, bool]:
    """Spark's rule: boosting ends once a round improves the best error by less than a share of the present one."""
    best = 1
    for at, error in enumerate(errors[1:], 2):
        if errors[best - 1] - error < tolerance * max(error, 0.01):
            return best, True
        if error < errors[best - 1]:
            best = at
    return best, False


def boost(
    table: Binned, growers: list[Grower], rounds: int, seed: int, rule: Callable[[list[float]], tuple[int, bool]] | None = None
) -> None:
    """Grow all ensembles side by side; every level of a round is one pass for all of them.

    ``rule`` gives the best round and whether to end, from the errors of all prefixes; without it every round counts.
    """
    table.forget()
    routes: dict[int, list[Route]] = {i: [] for i in range(len(growers))}
    for at in range(rounds + 1):
        if at and at % STRETCH == 0 and at < rounds:
            table.store(len(growers), routes)
            routes = {i: [] for i in routes}
        live = [i for i, g in enumerate(growers) if not g.done]
        roots = {i: Node(np.zeros(3)) for i in live} if at < rounds else {}
        fronts = {i: [roots[i]] if i in roots else [] for i in live}
        level = 0
        while any(fronts[i] for i in live) or (level == 0 and live):
            steps = []
            for i in live:
                if not fronts[i] and level:
                    continue
                g, places = growers[i], {id(node): place for place, node in enumerate(fronts[i])}
                front = Route(roots[i], lambda node: places.get(id(node), -1)) if fronts[i] else None
                if front is not None:
                    front.values = front.values.astype(np.int64)
                steps.append(Step(
                    i, routes[i], front, len(fronts[i]), at > 0, g.subsample, (seed << 20) + at, g.least_rows,
                    g.least_gain, at > 0 and level == 0,
                ))
            found = table.summed(steps)
            if level == 0 and at:
                for r in found:
                    if r.node < 0:
                        _check(growers[r.trial], r.stats, rule)
                live = [i for i in live if not growers[i].done]
            for i in live:
                fronts[i] = _split(fronts[i], {r.node: r for r in found if r.trial == i}, level, growers[i].max_depth)
            level += 1
        if not live:
            return
        for i in live if at < rounds else []:
            growers[i].trees.append(roots[i])
            weight = growers[i].weight(at)
            routes[i].append(Route(roots[i], lambda node: weight * node.prediction))


def _check(grower: Grower, stats: list[float], rule: Callable[[list[float]], tuple[int, bool]] | None) -> None:
    """Take the errors of the newest prefix and let the rule judge it."""
    grower.valid.append(stats[0] / stats[1] if stats[1] else float("nan"))
    grower.held.append(stats[2] / stats[3] if stats[3] else float("nan"))
    grower.best, grower.done = rule(grower.valid) if rule else (len(grower.held), False)


def _split(front: list[Node], choices: dict, level: int, max_depth: int) -> list[Node]:
    """Split the open nodes as chosen; those of their children that may be split again."""
    opened = []
    for place, node in enumerate(front):
        choice = choices.get(place)
        if choice is None:
            continue
        stats = np.array(choice.stats).reshape(-1, 3)
        node.sums = stats[0]
        if choice.feature < 0 or level >= max_depth:
            continue
        node.feature, node.cut, node.gain = choice.feature, choice.cut, choice.gain
        node.left, node.right = Node(stats[1]), Node(stats[2])
        opened += [c for c in (node.left, node.right) if level + 1 < max_depth and abs(c.impurity) >= PURE]
    return opened


def plain(node: Node) -> Node:
    """The tree without splits whose two leaves predict the same."""
    if node.left is None:
        return node
    left, right = plain(node.left), plain(node.right)
    if left.left is None and right.left is None and left.prediction == right.prediction:
        return Node(node.sums)
    return Node(node.sums, node.feature, node.cut, node.gain, left, right)
