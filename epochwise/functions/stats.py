"""Tail probabilities for the few rows of a finished aggregate.

Spark has no t, F or normal distribution function. These run as Arrow UDFs on result tables of
one row per feature, metric or model, never on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (continued fraction)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coef / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            h *= change
        if abs(change - 1.0) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_quantile_975(df: float) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > 0.05:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p of the smaller rank sum; counts subsets of 1..n by their sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return float(min(1.0, 2.0 * ways[: int(math.floor(w)) + 1].sum() / 2.0**n))


def signed_rank_normal(w: float, n: float, tie_term: float) -> float:
    """Normal approximation with tie correction."""
    if n < 1:
        return float("nan")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    return normal_two_sided((w - mean) / math.sqrt(var)) if var > 0 else float("nan")


def _columns(fn, *cols: pd.Series) -> pd.Series:
    out = []
    for row in zip(*cols):
        vals = [float("nan") if v is None else float(v) for v in row]
        res = float("nan") if any(math.isnan(v) for v in vals) else fn(*vals)
        out.append(None if math.isnan(res) else res)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _columns(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _columns(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    return _columns(t_quantile_975, df)


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return _columns(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def signed_rank_exact_pvalue(w: pd.Series, n: pd.Series) -> pd.Series:
    return _columns(lambda a, b: signed_rank_exact(a, int(b)) if b >= 1 else float("nan"), w, n)


@F.pandas_udf(T.DoubleType())
def signed_rank_normal_pvalue(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return _columns(signed_rank_normal, w, n, ties)


@F.pandas_udf(T.DoubleType())
def chi2_1_pvalue(x: pd.Series) -> pd.Series:
    return _columns(lambda v: math.erfc(math.sqrt(v / 2.0)) if v >= 0 else float("nan"), x)
