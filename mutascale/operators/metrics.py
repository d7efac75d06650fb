"""Regression fits and scores as aggregate columns: use inside ``agg`` with any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ols_slope(y: Column, x: Column) -> Column:
    """Least-squares slope; a constant x gives 0."""
    known = y.isNotNull() & x.isNotNull()
    return F.when(F.count_if(known) > 0, F.coalesce(F.regr_slope(y, x), F.lit(0.0)))


def ols_intercept(y: Column, x: Column) -> Column:
    """Least-squares intercept; a constant x gives the mean of y."""
    return F.coalesce(F.regr_intercept(y, x), F.avg(F.when(x.isNotNull(), y)))


def weighted_line(df: DataFrame, group: str, y: str, x: str, weight: str) -> DataFrame:
    """``coef, intercept, weight`` per group of the least-squares line; a row stands for ``weight`` equal rows.

    The moments are taken about the group's means, so nothing cancels where values are large against their spread. Rows
    without one of the sides count for the weight only. A constant x gives slope 0.
    """
    w = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.col(weight))
    means = df.groupBy(group).agg(
        (F.sum(w * F.col(y)) / F.sum(w)).alias("__my"), (F.sum(w * F.col(x)) / F.sum(w)).alias("__mx")
    )
    dx, dy, known = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my"), F.when(w.isNotNull(), F.col(x))
    sums = df.join(means, group).groupBy(group, "__mx", "__my").agg(
        F.sum(weight).alias("weight"), F.sum(w * dx * dy).alias("__xy"), F.sum(w * dx * dx).alias("__xx"),
        (F.min(known) < F.max(known)).alias("__varies"),
    )
    slope = F.when(F.col("__varies"), F.col("__xy") / F.col("__xx")).otherwise(F.lit(0.0))
    return sums.select(group, "weight", slope.alias("coef"), (F.col("__my") - slope * F.col("__mx")).alias("intercept"))


def confusion(actual: Column, predicted: Column, weight: Column | None = None) -> dict[str, Column]:
    """High/low counts by actual and predicted flag, optionally weighted."""
    n = F.lit(1).cast("long") if weight is None else weight

    def count(is_actual: Column, is_predicted: Column) -> Column:
        return F.sum(F.when(is_actual & is_predicted, n).otherwise(F.lit(0).cast("long")))

    return {
        "whfh": count(actual, predicted),
        "wlfl": count(~actual, ~predicted),
        "whfl": count(actual, ~predicted),
        "wlfh": count(~actual, predicted),
    }


def accuracy(whfh: Column, wlfl: Column, whfl: Column, wlfh: Column) -> Column:
    """Share of agreeing rows."""
    return F.try_divide((whfh + wlfl).cast("double"), (whfh + wlfl + whfl + wlfh).cast("double"))


def _paired(y: Column, p: Column) -> tuple[Column, Column]:
    """Both sides, null where the other is: every term then reads the same rows."""
    return F.when(p.isNotNull(), y), F.when(y.isNotNull(), p)


def r_squared(y: Column, p: Column) -> Column:
    """1 - SSres / SStot over the rows that have both sides; a constant y gives null."""
    y, p = _paired(y, p)
    return F.lit(1.0) - F.try_divide(F.sum(F.pow(y - p, F.lit(2.0))), F.count(y) * F.var_pop(y))


def rmse(y: Column, p: Column) -> Column:
    """Root mean squared error."""
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def rmsle(y: Column, p: Column) -> Column:
    """Root mean squared error of log(1 + value)."""
    return F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), F.lit(2.0))))


def concordance(y: Column, p: Column) -> Column:
    """Lin's concordance with population moments over the rows that have both sides.

    A constant side or a single point gives null.
    """
    y, p = _paired(y, p)
    shift = F.avg(y) - F.avg(p)
    spread = F.var_pop(y) + F.var_pop(p) + shift * shift
    varies = (F.min(y) < F.max(y)) & (F.min(p) < F.max(p))
    return F.when(varies, F.try_divide(F.lit(2.0) * F.covar_pop(y, p), spread))
