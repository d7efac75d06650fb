"""Linear models with a wide factor: its columns are absorbed level by level.

The columns that belong to one level of the wide factor (its own, and those of its interactions) are zero on the rows of all
other levels. So they are removed by a Schur complement within each level, next to the data: the cross products of the other
columns, less what the level's own columns explain. Only sums of these over the levels reach the driver, whose size is the
number of other columns; the number of levels is not bounded.

Within a level the moments are taken about the level's means before anything is subtracted, so a covariate that is large
against its spread loses no digits. The first level is the reference and is not absorbed, as in the coding of the dense fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import quoted
from mutascale.functions.stats import t_quantile, t_two_sided, t_two_sided_all

RANK_TOLERANCE = 1e-10
#: Rows of partial sums that are no cross products.
RANK, RAW, CENTRED, USED = -1, -2, -3, -4

#: Entries of the matrices of cells that a task holds at once; many levels of few columns are worked on together.
STACK = 1 << 18

Term = tuple[str, ...]
Parts = frozenset[Term]


def pseudo_inverse(part: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse on the independent columns, and their number, of one matrix or each of a stack.

    A column whose diagonal is lost in ``reference`` counts as none.
    """
    diagonal = np.diagonal(part, axis1=-2, axis2=-1)
    real = diagonal > reference
    scale = np.sqrt(np.where(real, diagonal, 1.0))
    both = real[..., :, None] & real[..., None, :]
    scales = scale[..., :, None] * scale[..., None, :]
    values, vectors = np.linalg.eigh(np.where(both, part / scales, 0.0))
    kept = values > RANK_TOLERANCE * np.max(values, axis=-1, keepdims=True, initial=0.0)
    basis = vectors * np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)[..., None, :]
    inverse = np.where(both, basis @ np.swapaxes(vectors, -1, -2) / scales, 0.0)
    return inverse, kept.sum(axis=-1)


@dataclass(frozen=True)
class Layout:
    """Columns of the part that is not absorbed: the intercept, the blocks of terms without the wide factor, the response."""

    wide: str
    reference: object
    blocks: dict[Term, range]
    numbers: int  # covariates and the response
    mean: float
    width: int

    @property
    def last(self) -> int:
        return self.width

    def columns(self, part: Term) -> list[int]:
        return list(self.blocks[part]) if part else [0]

    def parts(self, terms: list[Term]) -> Parts:
        return frozenset(tuple(x for x in t if x != self.wide) for t in terms if self.wide in t)

    def local(self, parts: Parts) -> list[int]:
        return [c for p in sorted(parts) for c in self.columns(p)]

    def is_reference(self, cells: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
        return np.array([level == self.reference for level in cells["level"].take(pa.array(first)).to_pylist()])

    def stacks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Cells of whole levels and the first row of each, so many as ``STACK`` allows but one level at least."""
        most = max(1, STACK // (self.width + 1) ** 2)
        for batch in _levels(batches):
            first = _first_rows(batch)
            while len(first):
                take = max(1, int(np.searchsorted(np.append(first[1:], batch.num_rows), most, side="right")))
                end = first[take] if take < len(first) else batch.num_rows
                yield batch.slice(0, end), first[:take]
                batch, first = batch.slice(end), first[take:] - end

    def moments(self, cells: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross products of each level's cells, about zero and about the level's means."""
        size, k, rows = self.width + 1, self.numbers, cells.num_rows
        n = cells["n"].to_numpy(zero_copy_only=False).astype(float)
        means = np.ones((rows, k + 1))
        means[:, 1:] = cells["means"].flatten().to_numpy(zero_copy_only=False).reshape(rows, k)
        means[:, k] -= self.mean
        entries = cells["entries"].flatten()
        at = np.repeat(np.arange(rows), pc.list_value_length(cells["entries"]).to_numpy(zero_copy_only=False))
        column, kind = (pc.struct_field(entries, name).to_numpy(zero_copy_only=False) for name in ("column", "kind"))
        kinds = np.zeros((rows, size), np.int64)
        kinds[at, column], kinds[:, self.last] = kind, k
        z = np.zeros((rows, size))
        z[at, column], z[:, self.last] = means[at, kind], means[:, k]
        covs = cells["covs"].flatten().to_numpy(zero_copy_only=False).reshape(rows, k, k) * n[:, None, None]
        mean = np.add.reduceat(n[:, None] * z, first) / np.add.reduceat(n, first)[:, None]
        away = z - np.repeat(mean, np.diff(np.append(first, rows)), axis=0)
        if len(first) == 1:  # may have many cells
            within = np.zeros((1, size, size))
            for a in range(1, k + 1):
                for b in range(1, k + 1):
                    within[0] += ((kinds == a) * covs[:, a - 1, b - 1, None]).T @ (kinds == b).astype(float)
            return (z * n[:, None]).T @ z + within, (away * n[:, None]).T @ away + within
        table = np.zeros((rows, k + 1, k + 1))
        table[:, 1:, 1:] = covs
        within = table[np.arange(rows)[:, None, None], kinds[:, :, None], kinds[:, None, :]]
        raw, centred = (np.add.reduceat(n[:, None, None] * x[:, :, None] * x[:, None, :] + within, first) for x in (z, away))
        return raw, centred

    def residual(self, raw: np.ndarray, centred: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
        """Each level's cross products less what its own columns explain, and their number."""
        base, rank = (centred.copy(), 1) if () in parts else (raw.copy(), 0)
        own = self.local(parts - {()})
        if own:
            part = base[:, own][:, :, own]
            inverse, more = pseudo_inverse(part, 1e-24 * np.diagonal(raw, axis1=1, axis2=2)[:, own])
            base, rank = base - base[:, :, own] @ inverse @ base[:, own, :], rank + more
            base[:, own, :] = 0.0
            base[:, :, own] = 0.0
        if () in parts:
            base[:, 0, :] = base[:, :, 0] = 0.0
        return base, np.broadcast_to(rank, len(base))


def _first_rows(batch: pa.RecordBatch) -> np.ndarray:
    """The first row of each level; the rows of a level come one after the other."""
    codes = pc.dictionary_encode(batch["level"]).indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end with a level; the last level of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = _first_rows(batch)
        if held and held[-1]["level"][0] == batch["level"][0]:
            end = first[1] if len(first) > 1 else batch.num_rows
            held.append(batch.slice(0, end))
            batch, first = batch.slice(end), first[1:] - end
            if not batch.num_rows:
                continue
        if held:
            yield pa.concat_batches(held)
        if first[-1]:
            yield batch.slice(0, first[-1])
        held = [batch.slice(first[-1])]
    if held:
        yield pa.concat_batches(held)


def _sums(layout: Layout, variants: list[Parts]) -> Callable:
    schema = pa.schema([("variant", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = layout.width + 1
        grams, ranks = np.zeros((len(variants), size, size)), np.zeros(len(variants))
        raws, centres = np.zeros(size), np.zeros(size)
        parts = sorted({p for v in variants for p in v})
        used = np.zeros(len(parts))
        seen = False
        for cells, first in layout.stacks(batches):
            seen = True
            raw, centred = layout.moments(cells, first)
            plain = np.diagonal(raw, axis1=1, axis2=2)
            raws += plain.sum(axis=0)
            own = ~layout.is_reference(cells, first)
            for one in raw[~own]:
                grams += one
                centres += np.diag(one)
            if not own.any():
                continue
            raw, centred, plain = raw[own], centred[own], plain[own]
            centres += np.diagonal(centred, axis1=1, axis2=2).sum(axis=0)
            used += [(plain[:, layout.columns(p)] > 0).sum() for p in parts]
            for at, variant in enumerate(variants):
                left, rank = layout.residual(raw, centred, variant)
                grams[at] += left.sum(axis=0)
                ranks[at] += rank.sum()
        if not seen:
            return
        v, i, j = np.nonzero(grams)
        upper = i <= j
        v, i, j = v[upper], i[upper], j[upper]
        rows = list(zip(v.tolist(), i.tolist(), j.tolist(), grams[v, i, j].tolist()))
        rows += [(at, RANK, 0, rank) for at, rank in enumerate(ranks)]
        rows += [(0, RAW, c, x) for c, x in enumerate(raws)] + [(0, CENTRED, c, x) for c, x in enumerate(centres)]
        rows += [(0, USED, c, x) for c, x in enumerate(used)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


@dataclass
class AbsorbedFit:
    """Sums over the levels for each set of absorbed parts, and the solutions taken from them."""

    model: object
    layout: Layout
    levels: dict[str, list]
    listed: DataFrame
    grams: dict[Parts, np.ndarray]
    ranks: dict[Parts, int]
    reference: np.ndarray
    counts: dict[Term, int]
    n: int

    @property
    def mean(self) -> float:
        return self.layout.mean

    def solve(self, terms: list[Term], intercept: bool = True, shift: float = 0.0):
        """Coefficients of the columns that stay, their pseudo-inverse, residual sum of squares and rank of all columns."""
        parts, last = self.layout.parts(terms), self.layout.last
        gram = self.grams[parts]
        columns = ([0] if intercept else []) + [c for t in terms if self.layout.wide not in t for c in self.layout.blocks[t]]
        toward = gram[columns, last] + shift * gram[columns, 0]
        total = gram[last, last] + 2 * shift * gram[0, last] + shift * shift * gram[0, 0]
        inverse, rank = pseudo_inverse(gram[np.ix_(columns, columns)], self.reference[columns])
        beta = inverse @ toward
        return columns, beta, inverse, max(float(total - beta @ toward), 0.0), int(rank) + self.ranks[parts]

    def rss(self, terms: list[Term], intercept: bool = True, shift: float = 0.0) -> tuple[float, int]:
        return self.solve(terms, intercept, shift)[3:]

    def used(self, term: Term) -> int:
        """Columns of a term that are not empty."""
        if self.layout.wide in term:
            return self.counts[tuple(x for x in term if x != self.layout.wide)]
        plain = np.diag(self.grams[frozenset()])
        return int((plain[list(self.layout.blocks[term])] > 0).sum())

    @property
    def total(self) -> float:
        return float(self.grams[frozenset()][self.layout.last, self.layout.last])

    @cached_property
    def effects(self) -> DataFrame:
        """``level``, and the estimates and variance factors of its own columns, by the number of the column they multiply."""
        terms = self.model.ordered_terms
        columns, beta, inverse, _, _ = self.solve(terms)
        layout = self.layout
        parts = layout.parts(terms)
        own = layout.local(parts)
        schema = pa.schema([
            ("level", self.listed_type), ("estimates", pa.map_(pa.int32(), pa.float64())),
            ("factors", pa.map_(pa.int32(), pa.float64())),
        ])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cells, first in layout.stacks(batches):
                raw, _ = layout.moments(cells, first)
                part = raw[:, own][:, :, own]
                plain = np.diagonal(part, axis1=1, axis2=2)
                inner, _ = pseudo_inverse(part, 1e-24 * plain)
                met = raw[:, own][:, :, columns]
                alpha = (inner @ (raw[:, own, layout.last] - met @ beta)[:, :, None])[:, :, 0]
                factor = np.diagonal(inner + inner @ met @ inverse @ np.swapaxes(met, 1, 2) @ inner, axis1=1, axis2=2)
                real = (plain > 0) & ~layout.is_reference(cells, first)[:, None]
                taken = np.flatnonzero(real.any(axis=1))
                ends = pa.array(np.append(0, np.cumsum(real[taken].sum(axis=1))).astype(np.int32))
                keys = pa.array(np.broadcast_to(np.array(own, np.int32), real.shape)[real], pa.int32())
                maps = (pa.MapArray.from_arrays(ends, keys, pa.array(x[real])) for x in (alpha, factor))
                yield pa.RecordBatch.from_arrays([cells["level"].take(pa.array(first[taken])), *maps], schema=schema)

        kind = self.listed.schema["level"].dataType.simpleString()
        return self.listed.mapInArrow(run, f"level {kind}, estimates map<int,double>, factors map<int,double>")

    @property
    def listed_type(self) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(self.listed.schema["level"].dataType)


def term_lists(model) -> list[list[Term]]:
    """The lists of terms that tables of type 2 and 3 compare."""
    terms = model.ordered_terms
    out = [terms, []]
    for term in terms:
        rest = [t for t in terms if t != term]
        second = [t for t in rest if not set(term) < set(t)]
        out += [rest, second, [*second, term]]
    return out


def fit_absorbed(cells: DataFrame, model, wide: str, levels: dict[str, list], indexed: DataFrame, entries, n: int, mean: float) -> AbsorbedFit:
    """``indexed`` has the cells with the level numbers of the other factors; ``entries`` gives their design entries."""
    blocks, width = {}, 1
    for term in model.ordered_terms:
        if wide not in term:
            size = math.prod(len(levels[f]) - 1 for f in term if f in model.factors)
            blocks[term] = range(width, width + size)
            width += size
    reference = cells.agg(F.min(quoted(wide))).first()[0]
    names = [f"m{i}" for i in range(len(model.covariates))] + ["y"]
    layout = Layout(wide, reference, blocks, len(names), mean, width)
    variants = sorted({layout.parts(t) for t in term_lists(model)}, key=sorted)
    cov = lambda a, b: F.col(f"cov_{names[min(a, b)]}_{names[max(a, b)]}")
    listed = indexed.select(
        quoted(wide).alias("level"), F.col("n"), F.array(*[F.col(f"mean_{x}") for x in names]).alias("means"),
        F.array(*[cov(a, b) for a in range(len(names)) for b in range(len(names))]).alias("covs"),
        entries(model, levels, blocks, wide).alias("entries"),
    ).repartition("level").sortWithinPartitions("level")
    parts = listed.mapInArrow(_sums(layout, variants), "variant int, i int, j int, value double")
    found = {(r["variant"], r["i"], r["j"]): r["value"] for r in parts.groupBy("variant", "i", "j").agg(
        F.sum("value").alias("value")).collect()}
    grams = {}
    for at, variant in enumerate(variants):
        gram = np.zeros((width + 1, width + 1))
        for (v, i, j), value in found.items():
            if v == at and i >= 0:
                gram[i, j] = gram[j, i] = value
        grams[variant] = gram
    ranks = {variant: int(found[at, RANK, 0]) for at, variant in enumerate(variants)}
    lost = np.array([1e-24 * found[0, RAW, c] + 1e-11 * found[0, CENTRED, c] for c in range(width + 1)])
    own = sorted({p for v in variants for p in v})
    counts = {p: int(found[0, USED, c]) for c, p in enumerate(own)}
    return AbsorbedFit(model, layout, levels, listed, grams, ranks, lost, counts, n)


def absorbed_coefficients(result: AbsorbedFit, names: list[str], level: float, schema: str) -> DataFrame:
    """The coefficient table: the columns that stay from the driver, those of the wide factor from the executors.

    The rows of one absorbed term share its place in the order.
    """
    model, layout = result.model, result.layout
    columns, beta, inverse, rss, rank = result.solve(model.ordered_terms)
    residual_df = result.n - rank
    sigma2 = rss / residual_df if residual_df > 0 else float("nan")
    reach = t_quantile(level, residual_df) if residual_df > 0 else float("nan")
    total = sum(result.used(t) for t in model.ordered_terms) + 1
    aliased = rank < total

    def row(order: int, name: str, estimate: float, factor: float) -> tuple:
        error = math.sqrt(max(sigma2 * factor, 0.0))
        t = estimate / error if error > 0 else None
        p = t_two_sided(t, residual_df) if t is not None else None
        return order, name, estimate, error, t, p, estimate - reach * error, estimate + reach * error, aliased

    plain = np.diag(result.grams[frozenset()])
    rows = [
        row(at, names[c], float(beta[at]) + (result.mean if c == 0 else 0.0), float(inverse[at, at]))
        for at, c in enumerate(columns) if plain[c] > 0
    ]
    out = model_rows = result.effects.sparkSession.createDataFrame(rows, schema)
    fields = model_rows.columns
    base = len(columns)
    tails = ["" if name == "Intercept" else f":{name}" for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch["estimates"].offsets.to_numpy()
            if not ends[-1] > ends[0]:
                continue
            levels = [f"{layout.wide}[{value}]" for value in batch["level"].to_pylist()]
            at = np.repeat(np.arange(len(levels)), np.diff(ends))
            number, estimate = (x.to_numpy()[ends[0] : ends[-1]] for x in (batch["estimates"].keys, batch["estimates"].items))
            first = batch["factors"].offsets[0].as_py()
            factor = batch["factors"].items.to_numpy()[first : first + len(at)]
            error = np.sqrt(np.maximum(sigma2 * factor, 0.0))
            sure = error > 0
            t, p = np.zeros(len(at)), np.zeros(len(at))
            t[sure] = estimate[sure] / error[sure]
            p[sure] = t_two_sided_all(t[sure], residual_df)
            yield pa.RecordBatch.from_arrays([
                pa.array((base + number).astype(np.int32)), pa.array([levels[i] + tails[c] for i, c in zip(at, number)], pa.string()),
                pa.array(estimate), pa.array(error), pa.array(t, mask=~sure), pa.array(p, mask=~sure),
                pa.array(estimate - reach * error), pa.array(estimate + reach * error), pa.array(np.full(len(at), aliased)),
            ], names=fields)

    return out.unionByName(result.effects.mapInArrow(run, schema))
