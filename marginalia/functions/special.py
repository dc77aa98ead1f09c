"""Survival functions that Spark lacks (AGG-24), as pandas UDFs over Arrow batches.

Series and continued fractions of the incomplete gamma and beta functions, for all rows of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x), the regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, 1e-300)) - _log_gamma(a), -np.inf))
    term, total = 1 / a, 1 / a
    for n in range(1, 400):  # the series, for x below a + 1
        term = term * x / (a + n)
        total = total + term
    with np.errstate(all="ignore"):
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for n in range(1, 400):  # the fraction, beyond
            an = -n * (n - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
    return np.clip(np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h)), 0, 1)


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b), the regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c = np.ones_like(z)
        d = 1 / (1 - (p + q) * z / (p + 1))
        h = d
        for m in range(1, 400):
            t = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 / (1 + t * d)
            c = 1 + t / c
            h = h * d * c
            t = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / (1 + t * d)
            c = 1 + t / c
            h = h * d * c
        out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


@F.pandas_udf(DoubleType())
def chi2_survival(chi2: pd.Series, freedom: pd.Series) -> pd.Series:
    """P(X >= chi2) at so many degrees of freedom; null in, null out."""
    x, k = chi2.to_numpy(float), freedom.to_numpy(float)
    ok = np.isfinite(x) & (k > 0)
    out = np.full(len(x), np.nan)
    if ok.any():
        out[ok] = gamma_upper(k[ok] / 2, x[ok] / 2)
    return pd.Series(out).where(ok, None)


@F.pandas_udf(DoubleType())
def binomial_survival(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of n draws at probability p."""
    kk, nn, pp = (v.to_numpy(float) for v in (k, n, p))
    out = np.where(kk <= 0, 1.0, 0.0)
    mid = (kk > 0) & (kk <= nn)
    if mid.any():
        out[mid] = beta_lower(kk[mid], nn[mid] - kk[mid] + 1, pp[mid])
    return pd.Series(out)
