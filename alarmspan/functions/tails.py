"""Distribution tails on small result tables: chi-squared quantile, two-sided Pearson p-value."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma by its power series / continued fraction."""
    if x <= 0.0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return total * scale
    b, c, d = x + 1.0 - a, 1e300, 1.0 / (x + 1.0 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return 1.0 - scale * h


def chi2_quantile(p: float, df: int) -> float:
    """Inverse chi-squared distribution by bisection."""
    lo, hi = 0.0, max(10.0, 2.0 * df)
    while _gamma_lower(df / 2.0, hi / 2.0) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if _gamma_lower(df / 2.0, mid / 2.0) < p else (lo, mid)
    return 0.5 * (lo + hi)


def _student_two_sided(r: float, n: float) -> float:
    """P(|t| >= observed) for n pairs: Student t with n - 2 degrees, by quadrature of the density's angle form."""
    if n < 3 or not math.isfinite(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    m = n - 2.0
    # t = sqrt(m) tan(phi): the tail is the integral of cos(phi)^(m-1) from arcsin|r| to pi/2.
    lo = math.asin(abs(r))
    x, w = np.polynomial.legendre.leggauss(200)
    reach = min(math.pi / 2, lo + 40.0 / math.sqrt(m + 1.0))
    phi = lo + (x + 1.0) * 0.5 * (reach - lo)
    area = 0.5 * (reach - lo) * np.sum(w * np.exp((m - 1.0) * np.log(np.cos(phi).clip(1e-300))))
    log_norm = math.lgamma((m + 1.0) / 2) - math.lgamma(m / 2) - 0.5 * math.log(math.pi)
    return float(min(1.0, 2.0 * area * math.exp(log_norm)))


def chi2_limit(df: Column, alpha: float) -> Column:
    """Upper chi-squared limit at level alpha for the degrees of freedom in ``df`` (one row per fitted model)."""
    @F.pandas_udf("double")
    def limit(k: pd.Series) -> pd.Series:
        known = {d: chi2_quantile(1.0 - alpha, int(d)) for d in k.unique()}
        return k.map(known)
    return limit(df)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation over n pairs (one row per channel pair)."""
    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_student_two_sided(a, b) for a, b in zip(r, n)])
    return p_value(r, n.cast("double"))
