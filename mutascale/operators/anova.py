"""Linear models with categorical factors: fits, ANOVA tables and coefficient tables.

The rows are reduced to one cell per combination of factor levels, the cells to the cross products of the design
columns. Only that matrix, whose size is the number of model columns, reaches the driver. Where a model has more than
``ABSORB_ABOVE`` columns its widest factor is absorbed level by level (see ``absorb``), and the matrix has the others only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mutascale.functions.scalar import quoted
from mutascale.functions.stats import f_tail, normality, t_quantile, t_two_sided
from mutascale.operators.absorb import AbsorbedFit, absorbed_coefficients, fit_absorbed
from mutascale.session import materialize

ABSORB_ABOVE = 400
RANK_TOLERANCE = 1e-10
INTERCEPT, RESIDUAL = "Intercept", "Residual"

ANOVA_SCHEMA = (
    "term_order int, factor string, sum_sq double, df long, F double, p_value double, eta_sq double, aliased boolean"
)
COEFFICIENT_SCHEMA = (
    "term_order int, coefficient string, estimate double, std_error double, t double, p_value double, "
    "ci_low double, ci_high double, aliased boolean"
)


@dataclass(frozen=True)
class LinearModel:
    """Response, factors, covariates and terms; a term is a tuple of names, at most one of them a covariate.

    The intercept is implied. Factors are coded against their first level, so a term needs all of its parts as terms.
    """

    response: str
    factors: tuple[str, ...]
    covariates: tuple[str, ...]
    terms: tuple[tuple[str, ...], ...]

    def __post_init__(self):
        known = {frozenset(t) for t in self.terms}
        for term in self.terms:
            if not set(term) <= {*self.factors, *self.covariates}:
                raise ValueError(f"term {term} names an unknown column")
            if len([x for x in term if x in self.covariates]) > 1:
                raise ValueError(f"term {term} has more than one covariate")
            for size in range(1, len(term)):
                if not all(frozenset(part) in known for part in combinations(term, size)):
                    raise ValueError(f"term {term} needs its parts as terms")

    @cached_property
    def ordered_terms(self) -> list[tuple[str, ...]]:
        """Factor-only terms first, each group by number of names."""
        return sorted(self.terms, key=lambda t: (any(x in self.covariates for x in t), len(t)))

    @property
    def columns(self) -> list[str]:
        return [self.response, *self.factors, *self.covariates]


@dataclass
class Fit:
    """Cross products of the design columns and the (centred) response, and the solutions taken from them."""

    model: LinearModel
    levels: dict[str, list]
    blocks: dict[tuple[str, ...], range]
    gram: np.ndarray
    n: int
    mean: float

    @property
    def last(self) -> int:
        return len(self.gram) - 1

    def solve(self, columns: list[int], shift: float = 0.0) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Coefficients, pseudo-inverse, residual sum of squares and rank using some of the columns.

        The matrix is scaled to a unit diagonal first. ``shift`` adds a constant to the response.
        """
        toward = self.gram[columns, self.last] + shift * self.gram[columns, 0]
        total = self.gram[self.last, self.last] + self.n * shift * shift
        part = self.gram[np.ix_(columns, columns)]
        scale = np.sqrt(np.where(np.diag(part) > 0, np.diag(part), 1.0))
        values, vectors = np.linalg.eigh(part / np.outer(scale, scale))
        kept = values > RANK_TOLERANCE * max(values.max(initial=0.0), 1e-300)
        basis = vectors[:, kept]
        inverse = (basis / values[kept]) @ basis.T / np.outer(scale, scale)
        beta = inverse @ toward
        return beta, inverse, max(float(total - beta @ toward), 0.0), int(kept.sum())

    def rss(self, terms: list[tuple[str, ...]], intercept: bool = True, shift: float = 0.0) -> tuple[float, int]:
        """Residual sum of squares and rank of the model with these terms."""
        return self.solve(self.columns_of(terms, intercept), shift)[2:]

    def used(self, term: tuple[str, ...]) -> int:
        """Columns of a term that are not empty."""
        return int(sum(self.gram[c, c] > 0 for c in self.blocks[term]))

    @property
    def total(self) -> float:
        return float(self.gram[self.last, self.last])

    def columns_of(self, terms: list[tuple[str, ...]], intercept: bool = True) -> list[int]:
        return ([0] if intercept else []) + [c for t in terms for c in self.blocks[t]]

    @cached_property
    def full(self) -> tuple[np.ndarray, np.ndarray, float, int]:
        return self.solve(list(range(self.last)))


def fit(df: DataFrame, model: LinearModel) -> Fit | AbsorbedFit:
    """Least-squares fit; rows with a missing value in a model column are dropped."""
    cells = materialize(_cells(df, model))
    counted = [F.count_distinct(quoted(f)) for f in model.factors]
    n, sy, *sizes = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("mean_y")), *counted).first()
    if not n:
        raise ValueError("no complete row to fit")
    mean, sizes = sy / n, dict(zip(model.factors, sizes))
    if 1 + sum(math.prod(sizes[f] - 1 for f in t if f in sizes) for t in model.terms) > ABSORB_ABOVE:
        wide = max((f for f in model.factors if any(f in t for t in model.terms)), key=lambda f: sizes[f])
        levels = {f: _levels(cells, f) for f in model.factors if f != wide}
        return fit_absorbed(cells, model, wide, levels, _with_level_index(cells, levels), _entries, int(n), mean)
    levels = {f: _levels(cells, f) for f in model.factors}
    blocks, width = {}, 1
    for term in model.ordered_terms:
        size = math.prod(len(levels[f]) - 1 for f in term if f in model.factors)
        blocks[term] = range(width, width + size)
        width += size
    indexed = _with_level_index(cells, levels)
    gram = np.zeros((width + 1, width + 1))
    for i, j, value in _products(indexed, model, levels, blocks, width, mean).collect():
        gram[i, j] = gram[j, i] = value
    return Fit(model, levels, blocks, gram, int(n), mean)


def _cells(df: DataFrame, model: LinearModel) -> DataFrame:
    """Per combination of levels: count, means, and co-moments about those means (numerically stable)."""
    complete = df.select(*[quoted(c) for c in model.columns]).dropna()
    numbers = {f"m{i}": quoted(c).cast("double") for i, c in enumerate(model.covariates)} | {
        "y": quoted(model.response).cast("double")
    }
    names = list(numbers)
    means = [F.avg(v).alias(f"mean_{k}") for k, v in numbers.items()]
    moments = [
        F.covar_pop(numbers[a], numbers[b]).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[i:]
    ]
    return complete.groupBy(*[quoted(f) for f in model.factors]).agg(F.count(F.lit(1)).alias("n"), *means, *moments)


def _levels(cells: DataFrame, factor: str) -> list:
    """Sorted levels of a factor that is not absorbed, so each is a column of the matrix on the driver."""
    return sorted(row[0] for row in cells.select(quoted(factor)).distinct().collect())


def _index_name(factor: str) -> str:
    return f"__level_{factor}"


def _with_level_index(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Attach the position of each factor's level; a level is a column of the matrix on the driver."""
    for factor, values in levels.items():
        kind = df.schema[factor].dataType.simpleString()
        schema = f"`{factor}` {kind}, `{_index_name(factor)}` int"
        table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], schema)
        df = df.join(table, factor)
    return df


def _entries(model: LinearModel, levels: dict[str, list], blocks: dict, absorbed: str | None = None) -> Column:
    """Non-zero design entries of a cell: struct(column, kind), kind 0 for a 1 and k for the k-th covariate."""
    entries = [F.struct(F.lit(0).alias("column"), F.lit(0).alias("kind"))]
    for term in (t for t in model.ordered_terms if absorbed not in t):
        position, active = F.lit(0), F.lit(True)
        for factor in [x for x in term if x in model.factors]:
            index = quoted(_index_name(factor))
            position = position * (len(levels[factor]) - 1) + (index - 1)
            active = active & (index > 0)
        kind = next((i + 1 for i, c in enumerate(model.covariates) if c in term), 0)
        entry = F.struct((F.lit(blocks[term].start) + position).alias("column"), F.lit(kind).alias("kind"))
        entries.append(F.when(active, entry))
    return F.array_compact(F.array(*entries))


def _products(cells: DataFrame, model: LinearModel, levels, blocks, width: int, mean: float) -> DataFrame:
    """Upper triangle of the cross products as (i, j, value); the response is the last column."""
    names = [f"m{i}" for i in range(len(model.covariates))] + ["y"]
    centre = {name: F.col(f"mean_{name}") for name in names}
    centre["y"] = F.col("mean_y") - F.lit(mean)
    n = F.col("n").cast("double")

    def moment(a: int, b: int) -> Column:
        if a == 0:
            return n if b == 0 else n * centre[names[b - 1]]
        low, high = names[a - 1], names[b - 1]
        return n * (F.col(f"cov_{low}_{high}") + centre[low] * centre[high])

    kinds = range(len(names) + 1)
    table = F.array(*[F.array(*[moment(min(a, b), max(a, b)) for b in kinds]) for a in kinds])
    response = F.array(F.struct(F.lit(width).alias("column"), F.lit(len(names)).alias("kind")))
    listed = cells.select(table.alias("moments"), F.concat(_entries(model, levels, blocks), response).alias("entries"))
    pairs = listed.withColumn("a", F.explode("entries")).withColumn("b", F.explode("entries"))
    value = F.element_at(F.element_at("moments", F.col("a.kind") + 1), F.col("b.kind") + 1)
    return (
        pairs.where(F.col("a.column") <= F.col("b.column"))
        .groupBy(F.col("a.column").alias("i"), F.col("b.column").alias("j"))
        .agg(F.sum(value).alias("value"))
    )


def anova_rows(result: Fit | AbsorbedFit, typ: int) -> list[tuple]:
    """(factor, sum_sq, df, columns) per term, in table order, without the residual."""
    terms = result.model.ordered_terms
    rows = []
    if typ == 3:
        full_rss, full_rank = result.rss(terms, shift=result.mean)
        rss, rank = result.rss(terms, intercept=False, shift=result.mean)
        rows.append((INTERCEPT, rss - full_rss, full_rank - rank, 1))
    for term in terms:
        others = [t for t in terms if t != term]
        if typ == 2:
            others = [t for t in others if not set(term) < set(t)]
        small_rss, small_rank = result.rss(others)
        large_rss, large_rank = result.rss(terms if typ == 3 else [*others, term])
        rows.append((":".join(term), small_rss - large_rss, large_rank - small_rank, result.used(term)))
    return rows


def anova_table(df: DataFrame, model: LinearModel, typ: int = 2, result: Fit | None = None) -> DataFrame:
    """ANOVA table of type 2 or 3 with effect sizes (share of the sums of squares of all rows of the table).

    ``df`` counts independent columns; ``aliased`` marks a term of which a part is determined by the other terms.
    """
    if typ not in (2, 3):
        raise ValueError("typ is 2 or 3")
    result = result or fit(df, model)
    rss, rank = result.rss(model.ordered_terms)
    residual_df = result.n - rank
    sigma2 = rss / residual_df if residual_df > 0 else None
    rows = []
    for factor, sum_sq, dof, columns in anova_rows(result, typ):
        sum_sq = max(sum_sq, 0.0)
        testable = dof > 0 and sigma2
        f_value = sum_sq / dof / sigma2 if testable else None
        p_value = f_tail(f_value, dof, residual_df) if testable else None
        rows.append((len(rows), factor, sum_sq if dof > 0 else 0.0, dof, f_value, p_value, None, dof < columns))
    rows.append((len(rows), RESIDUAL, rss, residual_df, None, None, None, False))
    table = df.sparkSession.createDataFrame(rows, ANOVA_SCHEMA)
    # The table has one row per term, so the unpartitioned window is bounded by the model.
    share = F.try_divide(F.col("sum_sq"), F.sum("sum_sq").over(Window.partitionBy()))
    return table.withColumn("eta_sq", share)


def coefficient_table(df: DataFrame, model: LinearModel, result: Fit | None = None, level: float = 0.05) -> DataFrame:
    """Estimates with standard errors, t tests and confidence limits, named ``factor[level]``.

    When columns are aliased the estimates are the minimum-norm ones on the scaled columns.
    """
    result = result or fit(df, model)
    if isinstance(result, AbsorbedFit):
        return absorbed_coefficients(result, _column_names(result, result.layout.wide), level, COEFFICIENT_SCHEMA)
    beta, inverse, rss, rank = result.full
    residual_df = result.n - rank
    sigma2 = rss / residual_df if residual_df > 0 else float("nan")
    reach = t_quantile(level, residual_df) if residual_df > 0 else float("nan")
    aliased = rank < int((np.diag(result.gram)[: result.last] > 0).sum())
    rows = []
    for column, name in enumerate(_column_names(result)):
        if result.gram[column, column] <= 0:
            continue
        estimate = float(beta[column]) + (result.mean if column == 0 else 0.0)
        error = math.sqrt(max(sigma2 * inverse[column, column], 0.0))
        t = estimate / error if error > 0 else None
        p = t_two_sided(t, residual_df) if t is not None else None
        rows.append((
            len(rows), name, estimate, error, t, p, estimate - reach * error, estimate + reach * error, aliased,
        ))
    return df.sparkSession.createDataFrame(rows, COEFFICIENT_SCHEMA)


def _column_names(result: Fit | AbsorbedFit, absorbed: str | None = None) -> list[str]:
    names = [INTERCEPT]
    for term in (t for t in result.model.ordered_terms if absorbed not in t):
        labels = [""]
        for part in term:
            coded = result.levels[part][1:] if part in result.model.factors else [None]
            tags = [part if v is None else f"{part}[{v}]" for v in coded]
            labels = [f"{label}:{tag}" if label else tag for label in labels for tag in tags]
        names += labels
    return names


def fit_statistics(df: DataFrame, model: LinearModel, result: Fit | None = None) -> Row:
    """R2, adjusted R2, overall F test, likelihood criteria, and normality tests of the residuals."""
    result = result or fit(df, model)
    rss, rank = result.rss(model.ordered_terms)
    n, total = result.n, result.total
    model_df, residual_df = rank - 1, n - rank
    r2 = 1.0 - rss / total if total > 0 else None
    f_value = (total - rss) / model_df / (rss / residual_df) if model_df and residual_df and rss > 0 else None
    log_likelihood = -n / 2.0 * (math.log(2 * math.pi) + math.log(rss / n) + 1.0) if rss > 0 else None
    shape = residuals(df, result).agg(F.skewness("residual").alias("s"), F.kurtosis("residual").alias("k")).first()
    moments = {"skew": shape["s"], "kurtosis": None if shape["k"] is None else shape["k"] + 3.0}
    tests = normality(n, moments["skew"], moments["kurtosis"]) if shape["s"] is not None else {}
    return Row(
        n=n, df_model=model_df, df_residual=residual_df, r_squared=r2,
        adj_r_squared=None if r2 is None or not residual_df else 1.0 - (1.0 - r2) * (n - 1) / residual_df,
        f_value=f_value, f_p=None if f_value is None else f_tail(f_value, model_df, residual_df),
        log_likelihood=log_likelihood,
        aic=None if log_likelihood is None else 2.0 * rank - 2.0 * log_likelihood,
        bic=None if log_likelihood is None else math.log(n) * rank - 2.0 * log_likelihood,
        **moments, **tests,
    )


def residuals(df: DataFrame, result: Fit | AbsorbedFit) -> DataFrame:
    """The complete rows with their residual; the coefficients travel as one literal array.

    Those of an absorbed factor are joined by its level; a level that holds a third of all rows may be split.
    """
    model = result.model
    rows = df.select(*[quoted(c) for c in model.columns]).dropna()
    indexed = _with_level_index(rows, result.levels)
    numbers = F.array(F.lit(1.0), *[quoted(c).cast("double") for c in model.covariates])
    if isinstance(result, AbsorbedFit):
        wide, own = result.layout.wide, result.effects.select(F.col("level").alias("__level"), "estimates").hint("rebalance")
        indexed = indexed.join(own, quoted(wide) == F.col("__level"), "left")
        entries = _entries(model, result.levels, result.layout.blocks, wide)
        _, found, *_ = result.solve(model.ordered_terms)  # all columns, in order
        beta = F.lit([float(b) for b in found])
    else:
        entries, beta = _entries(model, result.levels, result.blocks), F.lit([float(b) for b in result.full[0]])

    def term(e: Column) -> Column:
        value = F.element_at(beta, e["column"] + 1)
        if isinstance(result, AbsorbedFit):
            value = value + F.coalesce(F.try_element_at("estimates", e["column"]), F.lit(0.0))
        return value * F.element_at(numbers, e["kind"] + 1)

    fitted = F.aggregate(entries, F.lit(result.mean), lambda total, e: total + term(e))
    rows = indexed.withColumn("residual", quoted(model.response).cast("double") - fitted)
    return rows.select(*[quoted(c) for c in model.columns], "residual")
