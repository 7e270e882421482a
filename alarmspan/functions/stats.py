"""Guarded statistics as Column expressions; each works as an aggregate or over a window."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def finite(c: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def mean_abs(x: Column) -> Column:
    return F.avg(F.abs(x))


def crest(x: Column) -> Column:
    return F.max(F.abs(x)) / (rms(x) + F.lit(EPS))


def peak_to_peak(x: Column) -> Column:
    return F.max(x) - F.min(x)


def shape_factor(x: Column) -> Column:
    return (rms(x) + F.lit(EPS)) / (mean_abs(x) + F.lit(EPS))


def window_kurtosis(x: Column) -> Column:
    """Excess kurtosis with sigma + 1e-12 in the denominator: -3 for a constant window."""
    shrink = F.stddev_pop(x) / (F.stddev_pop(x) + F.lit(EPS))
    return F.coalesce((F.kurtosis(x) + 3.0) * F.pow(shrink, F.lit(4.0)) - 3.0, F.when(F.count(x) > 0, F.lit(-3.0)))


def window_skewness(x: Column) -> Column:
    shrink = F.stddev_pop(x) / (F.stddev_pop(x) + F.lit(EPS))
    return F.coalesce(F.skewness(x) * F.pow(shrink, F.lit(3.0)), F.when(F.count(x) > 0, F.lit(0.0)))


def snapshot_kurtosis(x: Column) -> Column:
    """Excess kurtosis of a raw snapshot: 0 below four samples or for a constant signal."""
    flat = (F.count(x) < 4) | (F.stddev_pop(x) < F.lit(EPS))
    return F.when(flat, F.lit(0.0)).otherwise(F.kurtosis(x))


def snapshot_skewness(x: Column) -> Column:
    flat = (F.count(x) < 3) | (F.stddev_pop(x) < F.lit(EPS))
    return F.when(flat, F.lit(0.0)).otherwise(F.skewness(x))


def pearson(a: Column, b: Column, over=None) -> Column:
    """Pearson r of the pairs with both values; NULL when either side is constant or there is no pair."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(wrap(F.covar_pop(x, y)), wrap(F.stddev_pop(x)) * wrap(F.stddev_pop(y)))


def pearson_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(pearson(a, b), F.lit(0.0))


def mean_of_present(cols: list[Column]) -> Column:
    """Row mean that skips nulls."""
    total, count = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
        count = count + F.when(c.isNotNull(), 1).otherwise(0)
    return F.try_divide(total, count.cast("double"))


def l2_norm(features: str | list[str]) -> Column:
    """Euclidean norm of a list of columns, or of one array column."""
    if isinstance(features, str):
        return F.sqrt(F.aggregate(features, F.lit(0.0), lambda acc, x: acc + x * x))
    total = F.lit(0.0)
    for c in features:
        total = total + F.col(c) * F.col(c)
    return F.sqrt(total)


def mean_magnitude(features: str | list[str]) -> Column:
    """Mean of absolute values of a list of columns, or of one array column."""
    if isinstance(features, str):
        return F.aggregate(features, F.lit(0.0), lambda acc, x: acc + F.abs(x)) / F.size(features)
    total = F.lit(0.0)
    for c in features:
        total = total + F.abs(F.col(c))
    return total / F.lit(float(len(features)))


def settled_round(c: Column, digits: int = 6) -> Column:
    """Half-up rounding nudged off exact ties and away from negative zero, for reported values."""
    return F.round(c + F.lit(1e-9), digits) + F.lit(0.0)
