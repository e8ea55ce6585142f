"""Distribution functions on columns. Densities are expressions; cumulative ones are Arrow-batched numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc, _lgamma = np.frompyfunc(math.erfc, 1, 1), np.frompyfunc(math.lgamma, 1, 1)


def norm_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2)).astype(float)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    x, a, b = np.broadcast_arrays(np.clip(np.asarray(x, float), 0, 1), np.asarray(a, float), np.asarray(b, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(t) + q * np.log1p(-t)) / p
        tiny = 1e-300
        c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        low = np.where(t <= 0, 0.0, np.where(t >= 1, 1.0, front * f))
    return np.where(swap, 1 - low, low)


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below shape + 1, continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(shape, float))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _lgamma(a).astype(float))
        term = total = 1 / a
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.all((np.abs(term) < np.abs(total) * 1e-16) | (x > a + 1)):
                break
        tiny = 1e-300
        b = x + 1 - a
        c, d = np.full_like(x, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
        h = d.copy()
        for n in range(1, 2000):
            num = -n * (n - a)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
            if np.all((np.abs(c * d - 1) < 1e-15) | (x <= a + 1)):
                break
    return np.where(x <= 0, 0.0, np.where(x <= a + 1, front * total, 1 - front * h))


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return np.where(t > 0, 1 - tail, tail)


def _tails(p: np.ndarray, lower: bool, log: bool) -> np.ndarray:
    p = p if lower else 1 - p
    if log:
        with np.errstate(divide="ignore"):
            return np.log(p)
    return p


def _udf(f: Callable[..., np.ndarray], *cols: Column | float, lower: bool = True, log: bool = False) -> Column:
    """f over batches; null where any argument is null."""
    n = len(cols)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        args = [s.to_numpy(float) for s in (x, y, z)][:n]
        ok = ~np.any([np.isnan(a) for a in args], axis=0)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = _tails(f(*(a[ok] for a in args)), lower, log)
        return pd.Series(out).where(ok, None)

    given = [c if isinstance(c, Column) else F.lit(float(c)) for c in cols]
    return run(*(c.cast("double") for c in (given + [F.lit(0.0)] * 3)[:3]))


def dnorm(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def pnorm(x: Column, mean: float = 0.0, sd: float = 1.0, lower: bool = True, log: bool = False) -> Column:
    z = (x - mean) / sd
    return _udf(norm_cdf, z if lower else -z, log=log)


def dlnorm(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return F.when(x > 0, dnorm(F.log(x), mean, sd) / x).when(x.isNotNull(), 0.0)


def plnorm(x: Column, mean: float = 0.0, sd: float = 1.0, lower: bool = True, log: bool = False) -> Column:
    z = F.when(x > 0, (F.log(x) - mean) / sd).when(x.isNotNull(), float("-inf"))
    return _udf(norm_cdf, z if lower else -z, log=log)


def dbeta(x: Column, a: float, b: float) -> Column:
    k = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return F.when((x > 0) & (x < 1), k * F.pow(x, a - 1) * F.pow(1 - x, b - 1)).when(x.isNotNull(), 0.0)


def pbeta(x: Column, a: float, b: float, lower: bool = True, log: bool = False) -> Column:
    return _udf(beta_cdf, x, a, b, lower=lower, log=log)


def dt(x: Column, df: float) -> Column:
    k = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return k * F.pow(1 + x * x / df, -(df + 1) / 2)


def pt(x: Column, df: float | Column, lower: bool = True, log: bool = False) -> Column:
    return _udf(t_cdf, x if lower else -x, df, log=log)


def dgamma(x: Column, shape: float, rate: float = 1.0) -> Column:
    return F.when(x > 0, F.exp((shape - 1) * F.log(x) - rate * x + shape * math.log(rate) - math.lgamma(shape))).when(x.isNotNull(), 0.0)


def pgamma(x: Column, shape: float | Column, rate: float = 1.0, lower: bool = True, log: bool = False) -> Column:
    return _udf(gamma_cdf, x * rate, shape, lower=lower, log=log)


def chi2_tail(chi2: Column, df: Column) -> Column:
    """p-value of a chi-square statistic."""
    return _udf(gamma_cdf, chi2 / 2, df / 2, lower=False)


def quantile(p: Column, cdf: Callable[[np.ndarray], np.ndarray], low: float, high: float, steps: int = 60) -> Column:
    """Smallest x in [low, high] with cdf(x) >= p, by bisection of whole batches."""

    def run(p: np.ndarray) -> np.ndarray:
        a, b = np.full(len(p), float(low)), np.full(len(p), float(high))
        for _ in range(steps):
            mid = (a + b) / 2
            below = cdf(mid) < p
            a, b = np.where(below, mid, a), np.where(below, b, mid)
        return b

    return _udf(run, p)


def to_sig_fig(x: Column, n: int) -> Column:
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def points(low: float, high: float, n: int) -> Column:
    """Array of n evenly spaced points, rounded to 6 decimals."""
    step = (high - low) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low + i * step, 6))
