"""Tail probabilities for the test statistics a fit produces; scalars, and one for arrays of many coefficients."""

from __future__ import annotations

import math

import numpy as np


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            change *= c * d
        total *= change
        if abs(change - 1.0) < 1e-15:
            break
    return math.exp(log_front) * total / a


def f_tail(value: float, df1: float, df2: float) -> float:
    """P(F > value)."""
    return beta_share(df2 / (df2 + df1 * value), df2 / 2.0, df1 / 2.0)


def t_two_sided(value: float, df: float) -> float:
    """P(|T| > |value|)."""
    return beta_share(df / (df + value * value), df / 2.0, 0.5)


def t_two_sided_all(values: np.ndarray, df: float) -> np.ndarray:
    """``t_two_sided`` of each value."""
    squares = values * values
    x = df / (df + squares)
    a, b = df / 2.0, 0.5
    out = np.empty(len(values))
    other = x > (a + 1.0) / (a + b + 2.0)
    out[~other] = _shares(x[~other], a, b)
    out[other] = 1.0 - _shares(1.0 - x[other], b, a)
    return out


def _shares(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The continued fraction of ``beta_share`` for many x; those that have converged are left out of further steps."""
    out = np.where(x >= 1.0, 1.0, np.where(x <= 0.0, 0.0, np.nan))
    at = np.flatnonzero((x > 0.0) & (x < 1.0))
    x = x[at]
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones(len(x)), 1.0 / np.maximum(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d.copy()
    for m in range(1, 10_000):
        if not len(at):
            break
        change = np.ones(len(at))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) > tiny, d, tiny)
            c = 1.0 + step / c
            c = np.where(np.abs(c) > tiny, c, tiny)
            change *= c * d
        total *= change
        open_ = np.abs(change - 1.0) >= 1e-15
        out[at[~open_]] = (front * total)[~open_]
        at, x, c, d, total, front = (v[open_] for v in (at, x, c, d, total, front))
    out[at] = front * total
    return out


def t_quantile(two_sided: float, df: float) -> float:
    """The t with P(|T| > t) equal to the given probability, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > two_sided:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > two_sided:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def normality(n: float, skew: float, kurtosis: float) -> dict[str, float | None]:
    """Jarque-Bera and the D'Agostino-Pearson omnibus test from moments; ``kurtosis`` is not the excess."""
    jb = n / 6.0 * (skew**2 + (kurtosis - 3.0) ** 2 / 4.0)
    out: dict[str, float | None] = {"jarque_bera": jb, "jarque_bera_p": math.exp(-jb / 2.0)}
    if n < 8:
        return {**out, "omnibus": None, "omnibus_p": None}
    # Skewness test (D'Agostino 1970).
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2.0 * (beta2 - 1.0)) - 1.0
    z_skew = math.asinh(y / math.sqrt(2.0 / (w2 - 1.0))) / math.sqrt(0.5 * math.log(w2))
    # Kurtosis test (Anscombe and Glynn 1983).
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + math.sqrt(1.0 + 4.0 / root**2))
    inner = (1.0 - 2.0 / a) / (1.0 + x * math.sqrt(2.0 / (a - 4.0)))
    z_kurt = (1.0 - 2.0 / (9.0 * a) - math.copysign(abs(inner) ** (1 / 3), inner)) / math.sqrt(2.0 / (9.0 * a))
    omnibus = z_skew**2 + z_kurt**2
    return {**out, "omnibus": omnibus, "omnibus_p": math.exp(-omnibus / 2.0)}
