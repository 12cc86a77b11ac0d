"""Tail probabilities as Arrow UDFs; they run on one row per feature, never on data rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"no convergence of the beta fraction at a={a}, b={b}, x={x}")


def _log_gamma_rise(a: float, b: float) -> float:
    """log gamma(a + b) - log gamma(a); from a of 50 by the asymptotic series, whose terms do not cancel."""
    if a < 50.0:
        return math.lgamma(a + b) - math.lgamma(a)
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return b * math.log(a) + (a + b - 0.5) * math.log1p(b / a) - b + series(a + b) - series(a)


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        _log_gamma_rise(max(a, b), min(a, b)) - math.lgamma(min(a, b)) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def chi2_tail(stat: float, df: int) -> float:
    """P(chi2_df > stat): closed forms for df 1 and 2, then the usual step of two degrees."""
    half = stat / 2.0
    if half <= 0.0:
        return 1.0
    tail, k = (math.erfc(math.sqrt(half)), 1) if df % 2 else (math.exp(-half), 2)
    while k < df:
        tail += math.exp(k / 2.0 * math.log(half) - half - math.lgamma(k / 2.0 + 1.0))
        k += 2
    return min(tail, 1.0)


def t_tail(rho: float, df: float) -> float:
    """Two-sided tail of a correlation with df degrees of freedom: I_{1 - rho^2}(df / 2, 1 / 2).

    From 1e6 degrees on, the expansion of Student's t around the normal law to 1 / df^2 is exact to
    double precision, where the fraction would need ever more terms.
    """
    square = min(rho * rho, 1.0)
    if df < 1e6 or square > 0.5:
        return incomplete_beta(df / 2.0, 0.5, 1.0 - square)
    t = math.sqrt(df * square / (1.0 - square))
    density = math.exp(-t * t / 2.0) / math.sqrt(2.0 * math.pi)
    first = t * (t * t + 1.0) / (4.0 * df)
    second = t * (3.0 * t**6 - 7.0 * t**4 - 5.0 * t**2 - 3.0) / (96.0 * df * df)
    return math.erfc(t / math.sqrt(2.0)) + 2.0 * density * (first + second)


@F.pandas_udf(T.DoubleType())
def correlation_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over n pairs, Student t with n - 2 degrees of freedom."""

    def one(rho: float, size: float) -> float | None:
        if rho is None or math.isnan(rho) or size < 3:
            return None
        return t_tail(rho, size - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, df: pd.Series) -> pd.Series:
    out = [None if math.isnan(s) or d < 1 else chi2_tail(s, int(d)) for s, d in zip(stat, df)]
    return pd.Series(out, dtype="float64")
