"""Upper-tail probabilities of the t, F and chi-square distributions, as one pandas UDF.

Spark SQL has no distribution functions. The results are rows of a small table of tests, so
the UDF sees a handful of values; it works on whole Arrow batches all the same.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300
PRECISION = 1e-15
# From here on the series below need thousands of terms, and expansions in 1/parameter are exact to rounding.
LARGE = 1e5

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _stirling_rest(a: np.ndarray) -> np.ndarray:
    """log gamma(a) less Stirling's formula for it."""
    large = np.maximum(a, 10.0)
    series = 1 / (12 * large) - 1 / (360 * large**3) + 1 / (1260 * large**5) - 1 / (1680 * large**7)
    small = np.minimum(a, 10.0)
    plain = _lgamma(small) - ((small - 0.5) * np.log(small) - small + 0.5 * math.log(2 * math.pi))
    return np.where(a > 10, series, plain)


def _log_excess(x: np.ndarray) -> np.ndarray:
    """x - log(1 + x), also for tiny x."""
    near = np.where(np.abs(x) < 1e-2, x, 0.0)
    series = near**2 * (1 / 2 - near * (1 / 3 - near * (1 / 4 - near * (1 / 5 - near * (1 / 6 - near * (1 / 7 - near / 8))))))
    return np.where(np.abs(x) < 1e-2, series, x - np.log1p(np.maximum(x, PRECISION - 1)))


def _continued_fraction(numerator, denominator, shape):
    """Evaluate b0 + a1/(b1 + a2/(b2 + ..)) by the modified Lentz method, batch-wise."""
    value = np.where(denominator(0) == 0, TINY, denominator(0)) * np.ones(shape)
    c, d = value.copy(), np.zeros(shape)
    for i in itertools.count(1):
        a, b = numerator(i), denominator(i)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        step = c * d
        value = value * step
        if np.all(np.abs(step - 1) < PRECISION):
            break
    return value


def _beta_front(p, q, x, y):
    """x^p y^q / B(p, q), without differences of large logarithms."""
    total = p + q
    # p log(x / x0) + q log(y / y0) at x0 = p / total; the linear parts cancel
    gap = np.where(x < y, x - p / total, q / total - y)
    power = -(p * _log_excess(gap * total / p) + q * _log_excess(-gap * total / q))
    rest = _stirling_rest(total) - _stirling_rest(p) - _stirling_rest(q)
    return np.exp(power + rest) * np.sqrt(p * q / (2 * math.pi * total))


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); `y` is 1 - x where that is known better."""
    y = 1 - np.asarray(x, dtype=float) if y is None else y
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x, y)))
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z, rest = np.where(flip, y, x), np.where(flip, x, y)
    inner, outer = np.clip(z, TINY, 1.0), np.clip(rest, TINY, 1.0)
    both = np.minimum(p, q) > LARGE
    # where a parameter is large the fraction is replaced below, so it gets easy numbers there
    large = np.maximum(p, q) > LARGE
    u, v, w = np.where(large, 1.0, p), np.where(large, 1.0, q), np.where(large, 0.5, inner)

    def numerator(i):
        if i == 1:
            return np.ones_like(w)
        m = (i - 1) // 2
        if i % 2:
            return m * (v - m) * w / ((u + 2 * m - 1) * (u + 2 * m))
        return -(u + m) * (u + v + m) * w / ((u + 2 * m) * (u + 2 * m + 1))

    # the fraction is 1/(1 + d1/(1 + d2/(1 + ..))); term i carries the coefficient d(i-1)
    fraction = _continued_fraction(numerator, lambda i: np.zeros_like(w) if i == 0 else np.ones_like(w), w.shape)
    front = _beta_front(p, q, inner, outer)
    # uniform expansion around the normal tail, to the second term
    total = p + q
    gap = np.where(inner < outer, inner - p / total, q / total - outer)
    half = (p * _log_excess(gap * total / p) + q * _log_excess(-gap * total / q)) / total
    eta = np.sign(gap) * np.sqrt(2 * np.maximum(half, 0.0))
    width = np.sqrt(p * q) / total
    apart = np.abs(eta) > 1e-4
    safe = np.where(apart, eta, 1.0)
    first = np.where(apart, 1 / safe - width / np.where(apart, gap, 1.0), (q - p) / (3 * np.sqrt(p * q)))
    normal = 0.5 * _erfc(-eta * np.sqrt(total / 2)) + np.exp(-total * eta * eta / 2) / np.sqrt(2 * math.pi * total) * first
    small = np.where(z <= 0, 0.0, np.clip(np.where(both, normal, front / p * fraction), 0.0, 1.0))
    plain = np.where(flip, 1 - small, small)
    # one large parameter: a gamma tail, exact to its inverse square
    left, right = (a > LARGE) & (b <= LARGE), (b > LARGE) & (a <= LARGE)
    shape, other, share = np.where(left, b, np.where(right, a, 1.0)), np.where(left, a, b), np.where(left, y, np.where(right, x, 0.5))
    tail = gamma_tail(shape, -(other + (shape - 1) / 2) * np.log1p(-np.minimum(share, 1 - PRECISION)))
    return np.where(left, tail, np.where(right, 1 - tail, plain))


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    safe = np.clip(x, TINY, None)
    large = a > LARGE
    u, w = np.where(large, 1.0, a), np.where(large, 1.0, safe)
    front = np.exp(u * np.log(w) - w - _lgamma(u))
    low = w < u + 1
    # below the mean: series for the lower tail
    term, total = 1 / u, 1 / u
    near = np.where(low, w, 0.0)
    for i in itertools.count(1):
        term = term * near / (u + i)
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * PRECISION):
            break
    # above it: continued fraction for the upper tail
    far = np.where(low, u + 1, w)
    fraction = _continued_fraction(
        lambda i: np.ones_like(far) if i == 1 else -(i - 1) * (i - 1 - u),
        lambda i: np.zeros_like(far) if i == 0 else far + 2 * i - 1 - u,
        far.shape,
    )
    plain = np.where(low, 1 - front * total, front * fraction)
    # uniform expansion around the normal tail, to the second term
    gap = safe / a - 1
    eta = np.sign(gap) * np.sqrt(2 * _log_excess(gap))
    apart = np.abs(eta) > 1e-3
    first = np.where(apart, 1 / np.where(apart, gap, 1.0) - 1 / np.where(apart, eta, 1.0), -1 / 3 + eta / 12)
    normal = 0.5 * _erfc(eta * np.sqrt(a / 2)) + np.exp(-a * eta * eta / 2) / np.sqrt(2 * math.pi * a) * first
    return np.where(x <= 0, 1.0, np.clip(np.where(large, normal, plain), 0.0, 1.0))


def _tails(kind: np.ndarray, statistic: np.ndarray, dof1: np.ndarray, dof2: np.ndarray) -> np.ndarray:
    p = np.full(len(kind), np.nan)
    usable = np.isfinite(dof1) & ~np.isnan(statistic)
    for name in ("t", "f", "chi2"):
        m = usable & (kind == name) & (np.isfinite(dof2) if name == "f" else True)
        if not m.any():
            continue
        s, d1, d2 = statistic[m], dof1[m], dof2[m]
        endless = np.isinf(s)
        s = np.where(endless, 0.0, s)
        if name == "t":
            # a large t leaves x near 0, where the tail is accurate
            tail = beta_tail(d1 / 2, np.full_like(d1, 0.5), d1 / (d1 + s * s), s * s / (d1 + s * s))
        elif name == "f":
            tail = beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * s), d1 * s / (d2 + d1 * s))
        else:
            tail = gamma_tail(d1 / 2, s / 2)
        p[m] = np.where(endless, 0.0, np.clip(tail, 0.0, 1.0))
    return p


@F.pandas_udf(T.DoubleType())
def tail_probability(kind: pd.Series, statistic: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
    """p-value: kind `t` is two-sided, `f` and `chi2` are upper tails."""
    numbers = [s.astype(float).to_numpy() for s in (statistic, dof1, dof2)]
    p = _tails(kind.to_numpy(dtype=object), *numbers)
    return pd.Series(p).where(~np.isnan(p), None).astype("Float64")
