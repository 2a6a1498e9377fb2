"""Student-t quantile and p-value as Arrow-batched functions.

They run on grouped results (one row per workload), never on fact rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):  # about sqrt(max(a, b)) terms are needed
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            return out
    raise ArithmeticError(f"the continued fraction of the beta function does not settle for {a}, {b}, {x}")


def _beta_ratio(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|) for ``df`` degrees of freedom."""
    if not (math.isfinite(t) and math.isfinite(df) and df > 0):
        return float("nan")
    return _beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """The value t with P(T <= t) = p, by bisection on the monotone tail."""
    if not (math.isfinite(df) and df > 0 and 0.0 < p < 1.0):
        return float("nan")
    tail = 2.0 * min(p, 1.0 - p)
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if two_sided_p(mid, df) > tail:
            low = mid
        else:
            high = mid
    return math.copysign((low + high) / 2.0, p - 0.5)


def t_quantile(p: float, df):
    """Column of t quantiles at probability ``p``."""

    @F.pandas_udf("double")
    def run(freedom: pd.Series) -> pd.Series:
        return freedom.map(lambda d: quantile(p, d) if d == d else np.nan).astype(float)

    return run(df)


def t_p_value(t, df):
    """Column of two-sided p-values."""

    @F.pandas_udf("double")
    def run(stat: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, b) for a, b in zip(stat.astype(float), freedom.astype(float))], dtype=float)

    return run(t, df)
