"""Exact binomial tails whose cost doesn't grow with n."""

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def upper_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) for X binomial (n, p), as the regularised incomplete beta function I_p(k, n - k + 1) by its continued fraction.

    It neither starts from (1 - p)^n, which underflows for large n, nor adds up n terms.
    """
    k, n, p = (np.asarray(x, float) for x in (k, n, p))
    out = np.where((k <= 0) | ((p >= 1) & (k <= n)), 1.0, 0.0)
    use = np.flatnonzero((k > 0) & (k <= n) & (p > 0) & (p < 1))
    if not len(use):
        return out
    a, b, x = k[use], n[use] - k[use] + 1, p[use]
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(a), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * (d * c)
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    beta = front * h
    out[use] = np.clip(np.where(flip, 1 - beta, beta), 0, 1)
    return out


@pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Null where any argument is."""
    null = k.isna() | n.isna() | p.isna()
    return pd.Series(upper_tail(k.fillna(0), n.fillna(0), p.fillna(0))).where(~null.to_numpy())
