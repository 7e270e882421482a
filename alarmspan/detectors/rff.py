"""One-class boundary with an RBF kernel: random Fourier features and a linear one-class objective."""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.detectors.base import Detector, register_detector
from alarmspan.layout import Layout
from alarmspan.operators.ordered import settle
from alarmspan.operators.quantile import quantile_table
from alarmspan.session import cut_lineage


@lru_cache(maxsize=4)
def _projection(width: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W and b, drawn once by each Python worker."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((width, dim)), rng.uniform(0.0, 2.0 * np.pi, dim)


def fourier_features(features: Column, gamma: Column, dim: int, seed: int) -> Column:
    """sqrt(2/D) cos(sqrt(2 gamma) W x + b) with seeded W, b: inner products approximate exp(-gamma |x - y|^2)."""
    @F.pandas_udf("array<double>")
    def lift(x: pd.Series, g: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        m = np.vstack(x.to_numpy()).astype(float)
        w, b = _projection(m.shape[1], dim, seed)
        z = np.sqrt(2.0 / dim) * np.cos(np.sqrt(2.0 * g.to_numpy(dtype=float))[:, None] * (m @ w) + b)
        return pd.Series(list(z))
    return lift(features, gamma)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _mean_vector(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    items = df.select(*keys, F.posexplode(col).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    return items.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(out))


def cell_variance(features: str) -> Column:
    """Variance of all cells of rows of one width, as an aggregate: within rows, and between their means."""
    mean = F.aggregate(features, F.lit(0.0), lambda a, x: a + x) / F.size(features)
    within = F.aggregate(F.transform(features, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size(features)
    return F.avg(within) + F.var_pop(mean)


def one_class_svm(features: str = "features", nu: float = 0.05, kernel: str = "rbf", gamma: str = "scale", dim: int = 128,
                  passes: int = 12, seed: int = 42, tolerance: float = 0.02) -> Detector:
    """Boundary rho - w.phi(x), above zero outside.

    The dual is solved by conditional-gradient steps: a pass finds the nu-share of rows with the lowest w.phi and moves
    w towards their mean, as far as shortens it most.  Each pass is a join with one small row per series, an exact
    percentile and a combined sum.  w.(w - mean) bounds how far |w|^2 / 2 is above its least value: passes end when no
    series' bound is above ``tolerance`` of |w|^2, or after ``passes``; the model's ``gap`` column says what was reached.
    """
    def fit(train: DataFrame, lay: Layout) -> DataFrame:
        keys = list(lay.keys)
        var = cell_variance(features)
        scale = train.groupBy(*keys).agg((F.lit(1.0) / (F.any_value(F.size(features)) * F.when(var > 0, var).otherwise(F.lit(1.0)))).alias("gamma"))
        lifted = train.select(*keys, features).join(scale, keys)
        rows = cut_lineage(lifted.select(*keys, fourier_features(F.col(features), F.col("gamma"), dim, seed).alias("phi")), "rff")
        state = cut_lineage(_mean_vector(rows, keys, "phi", "w").withColumn("gap", F.lit(None).cast("double")), "rff-w")
        for _ in range(passes):
            placed = settle(rows.join(state.drop("gap"), keys).withColumn("_d", _dot("phi", "w")), lay, "rff-pass")
            edge = quantile_table(placed.select(*keys, "_d"), lay, F.col("_d"), {"rho": nu})
            outside = placed.join(edge, keys).where(F.col("_d") <= F.col("rho"))
            target = _mean_vector(outside.select(*keys, "phi"), keys, "phi", "_t")
            met = state.drop("gap").join(target, keys).withColumn("_off", F.zip_with("w", "_t", lambda a, b: a - b))
            gap, far = _dot("w", "_off"), _dot("_off", "_off")
            rate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(gap, far), F.lit(0.0))))
            met = met.withColumns({"_rate": rate, "gap": F.coalesce(F.try_divide(gap, _dot("w", "w")), F.lit(0.0))})
            state = cut_lineage(met.select(*keys, F.zip_with("w", "_off", lambda a, d: a - d * F.col("_rate")).alias("w"), "gap"), "rff-w")
            worst = state.agg(F.max("gap")).first()[0]
            if worst is None or worst <= tolerance:
                break
        final = rows.join(state.drop("gap"), keys).select(*keys, _dot("phi", "w").alias("_d"))
        rho = quantile_table(settle(final, lay, "rff-rho"), lay, F.col("_d"), {"rho": nu})
        return cut_lineage(state.join(rho, keys).join(scale, keys), "rff-model")

    def score(rows: DataFrame, params: DataFrame, lay: Layout) -> DataFrame:
        shared = [k for k in lay.keys if k in params.columns]
        lifted = rows.join(params, shared).withColumn("phi", fourier_features(F.col(features), F.col("gamma"), dim, seed))
        return lifted.withColumn("score", F.col("rho") - _dot("phi", "w")).drop("phi", "w", "rho", "gamma", "gap", features)

    return Detector(f"One-Class SVM (nu={nu})", "one_class_svm", fit, score)


register_detector("one_class_svm", one_class_svm)
