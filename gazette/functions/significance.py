"""Tail probabilities Spark has no function for.

They are evaluated on result rows (a handful of test statistics), never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float | None, n: float | None) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    # t^2 = r^2 (n-2) / (1-r^2), and P(|T| > t) = I_{1-r^2}((n-2)/2, 1/2).
    return incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - min(r * r, 1.0))


def chi_square_p(chi2: float | None, dof: float | None) -> float | None:
    """Upper tail of the chi-square distribution."""
    if chi2 is None or dof is None or math.isnan(chi2) or dof < 1:
        return None
    if chi2 <= 0.0:
        return 1.0
    a, x = dof / 2.0, chi2 / 2.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        step = a
        while abs(term) > abs(total) * 1e-16:
            step += 1.0
            term *= x / step
            total += term
        return 1.0 - total * scale
    # Continued fraction of the upper incomplete gamma function.
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value * scale


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(x, m) for x, m in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_p(x, d) for x, d in zip(chi2, dof)], dtype="float64")
