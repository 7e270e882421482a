"""Closed-form detectors: three-sigma on the feature norm, smoothed mean magnitude."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.detectors.base import Detector, register_detector
from alarmspan.functions.stats import EPS, l2_norm, mean_magnitude
from alarmspan.layout import Layout
from alarmspan.operators.ordered import ewma


def _fit_moments(index):
    def fit(train: DataFrame, lay: Layout) -> DataFrame:
        return train.groupBy(*lay.keys).agg(
            F.avg(index).alias("_mu"), (F.stddev_pop(index) + F.lit(EPS)).alias("_sigma"))
    return fit


def three_sigma(features, n_sigma: float = 3.0) -> Detector:
    """Absolute deviation of the feature vector's norm from its training mean, in training sigmas."""
    index = l2_norm(features)

    def score(rows: DataFrame, params: DataFrame, lay: Layout) -> DataFrame:
        joined = rows.join(params, [k for k in lay.keys if k in params.columns])
        return joined.withColumn("score", F.abs((index - F.col("_mu")) / F.col("_sigma"))).drop("_mu", "_sigma")

    return Detector(f"3σ Rule (σ={n_sigma})", "three_sigma", _fit_moments(index), score)


def ewma_chart(features, lambda_: float = 0.2, k: float = 3.0) -> Detector:
    """Deviation of the smoothed mean magnitude from its training mean, in training sigmas.

    Smoothing starts from the training mean anew for every scored set.
    """
    index = mean_magnitude(features)

    def score(rows: DataFrame, params: DataFrame, lay: Layout) -> DataFrame:
        joined = rows.join(params, [c for c in lay.keys if c in params.columns])
        smooth = ewma(joined, lay, index, lambda_, F.col("_mu"), "_e")
        return smooth.withColumn("score", F.abs(F.col("_e") - F.col("_mu")) / F.col("_sigma")) \
                     .drop("_mu", "_sigma", "_e")

    return Detector(f"EWMA (λ={lambda_}, k={k})", "ewma", _fit_moments(index), score)


register_detector("three_sigma", three_sigma)
register_detector("ewma", ewma_chart)
