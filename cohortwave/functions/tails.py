"""Distribution tails Spark has no built-in for, as Arrow-batched functions.

They run on rows of test statistics, which are few; the statistics themselves
are computed with ordinary aggregates.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma: series below a+1, continued
    fraction above."""
    a, x = np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0)
    out = np.ones_like(x)
    scale = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - _lgamma(a))
    small = (x > 0) & (x < a + 1)
    term = np.where(small, 1.0 / a, 0.0)
    total, n = term.copy(), a.copy()
    for _ in range(2000):
        n = n + 1
        term = term * np.where(small, x, 0.0) / n
        total += term
        if not np.any(term > total * 1e-17):
            break
    out = np.where(small, 1.0 - total * scale, out)
    large = x >= a + 1
    b = np.where(large, x + 1.0 - a, 1.0)
    c = np.full_like(x, 1e300)
    d = 1.0 / b
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step[large] - 1.0) < 1e-15):
            break
    return np.where(large, h * scale, out)


def _beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    zs = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zs) + q * np.log1p(-zs)) / p
    c = np.ones_like(z)
    d = 1.0 / (1.0 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 1000):
        e = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 / (1.0 + e * d)
        c = 1.0 + e / c
        h = h * d * c
        e = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 / (1.0 + e * d)
        c = 1.0 + e / c
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    val = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1.0 - val, val)


@pandas_udf(DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    ok = (x.notna() & (df > 0)).to_numpy()
    out = np.full(len(x), np.nan)
    if ok.any():
        out[ok] = _gamma_q(df[ok].to_numpy(float) / 2, x[ok].to_numpy(float) / 2)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = (t.notna() & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if ok.any():
        tv, dv = t[ok].to_numpy(float), df[ok].to_numpy(float)
        out[ok] = _beta_i(dv / 2, np.full_like(dv, 0.5), dv / (dv + tv * tv))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    out = []
    for n11, n12, n21, n22 in zip(a, b, c, d):
        r1, r2, c1 = n11 + n12, n21 + n22, n11 + n21
        n = r1 + r2
        if min(r1, r2, c1, n - c1) <= 0:
            out.append(None)
            continue
        k = np.arange(max(0, c1 - r2), min(r1, c1) + 1, dtype=float)
        const = math.lgamma(r1 + 1) + math.lgamma(r2 + 1) + math.lgamma(c1 + 1) + math.lgamma(n - c1 + 1) - math.lgamma(n + 1)
        logp = const - _lgamma(k + 1) - _lgamma(r1 - k + 1) - _lgamma(c1 - k + 1) - _lgamma(r2 - c1 + k + 1)
        p = np.exp(logp)
        out.append(float(min(1.0, p[p <= p[int(n11 - k[0])] * (1 + 1e-7)].sum())))
    return pd.Series(out, dtype=object)


def chi2_sf(x: Column, df: Column) -> Column:
    return _chi2_sf(x.cast("double"), df.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return _t_two_sided(t.cast("double"), df.cast("double"))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2x2 table of counts; NULL when degenerate. The
    sum over tables is at most the smaller margin + 1 terms."""
    return _fisher(*[v.cast("double") for v in (a, b, c, d)])


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    num, den = a.cast("double") * d, b.cast("double") * c
    return F.when(den > 0, num / den).when(num > 0, F.lit(float("inf")))
