"""Tail probabilities for the few result rows of a test."""

from __future__ import annotations

import math

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these small functions by value; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    return beta_share(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _over(fn, *columns: pd.Series) -> pd.Series:
    rows = zip(*(c.to_numpy(dtype=float) for c in columns))
    return pd.Series([np.nan if any(map(math.isnan, r)) else fn(*r) for r in rows], dtype=float)


@F.pandas_udf(T.DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def p_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _over(f_tail, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _over(chi2_tail, x, df)


@F.pandas_udf(T.DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return _over(normal_two_sided, z)
