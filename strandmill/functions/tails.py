"""Tails of distributions, as Arrow functions over batches: no SciPy is needed.

Each is P(X > k) unless said otherwise.  Sums run over the shorter, decaying part of a distribution.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method, for whole arrays.

    Each element stops by itself, so its value doesn't depend on its batch.
    """
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    live = np.ones(x.shape, bool)
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = np.where(live, h * step, h)
        live &= np.abs(step - 1) >= 1e-14
        if not live.any():
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1, 1.0, 0.0)
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if ok.any():
        a, b, x = a[ok], b[ok], x[ok]
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)) / p
        v = front * _beta_fraction(p, q, y)
        out[ok] = np.clip(np.where(swap, 1 - v, v), 0, 1)
    return out


def binomial_tail(k, p, n) -> np.ndarray:
    k, p, n = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, p, n)))
    inner = beta_inc(np.maximum(k, 0) + 1, np.maximum(n - k, 1e-9), np.clip(p, 0, 1))
    return np.where(k >= n, 0.0, np.where(k < 0, 1.0, inner))


def poisson_tail(k, mu) -> np.ndarray:
    """P(X > k) by the series from k + 1 where that decays, else 1 less the series down from k."""
    k, mu = np.broadcast_arrays(np.asarray(k, float), np.asarray(mu, float))
    out = np.where(k < 0, 1.0, 0.0)
    for i in np.ndindex(k.shape):
        if k[i] >= 0 and mu[i] > 0:
            up = k[i] + 1 > mu[i]
            j = k[i] + 1 if up else k[i]
            term = math.exp(j * math.log(mu[i]) - mu[i] - math.lgamma(j + 1))
            total = 0.0
            while term > 1e-18 * max(total, 1e-300) and j >= 0:
                total += term
                j, term = (j + 1, term * mu[i] / (j + 1)) if up else (j - 1, term * j / mu[i])
            out[i] = min(1.0, total) if up else max(0.0, 1 - total)
    return out


def normal_tail(z) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) if v == v else math.nan for v in np.asarray(z, float).ravel()])


def t_tail(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(np.isnan(t) | (df <= 0), 1.0, np.where(t > 0, half, 1 - half))


def poisson_draw(mu, u) -> np.ndarray:
    """The least k with P(X <= k) of ``u`` or more; sums start 20 standard deviations below the mean."""
    mu, u = np.asarray(mu, float), np.asarray(u, float)
    k = np.maximum(0, np.floor(mu - 20 * np.sqrt(mu)))
    p = np.exp(np.where(mu > 0, k * np.log(np.where(mu > 0, mu, 1)), 0) - mu - _lgamma(k + 1).astype(float))
    total, last = p.copy(), mu + 40 * np.sqrt(mu) + 40
    while (on := (total < u) & (k < last)).any():
        k = k + on
        p = np.where(on, p * mu / np.maximum(k, 1), p)
        total = np.where(on, total + p, total)
    return k


def hypergeometric_at_least(k: int, good: int, bad: int, draws: int) -> float:
    """P(X >= k)."""
    total, log_all = 0.0, math.lgamma(good + bad + 1) - math.lgamma(draws + 1) - math.lgamma(good + bad - draws + 1)
    for j in range(max(k, draws - bad, 0), min(good, draws) + 1):
        total += math.exp(math.lgamma(good + 1) - math.lgamma(j + 1) - math.lgamma(good - j + 1) + math.lgamma(bad + 1) - math.lgamma(draws - j + 1) - math.lgamma(bad - draws + j + 1) - log_all)
    return min(1.0, total)


@pandas_udf(DoubleType())
def binomial_q(k: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(binomial_tail(k, p, n))


@pandas_udf(DoubleType())
def poisson_q(k: pd.Series, mu: pd.Series) -> pd.Series:
    return pd.Series(poisson_tail(k, mu))


@pandas_udf(DoubleType())
def poisson_sample(mu: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series(poisson_draw(mu, u))


@pandas_udf(DoubleType())
def normal_q(z: pd.Series) -> pd.Series:
    return pd.Series(normal_tail(z))


@pandas_udf(DoubleType())
def t_q(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t, df))


@pandas_udf(DoubleType())
def hypergeometric_p(k: pd.Series, good: pd.Series, bad: pd.Series, draws: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_at_least(*map(int, x)) for x in zip(k, good, bad, draws, strict=True)])
