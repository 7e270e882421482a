"""Decision thresholds from training scores: percentile, smoothed control limit, tail fit, per-step limit."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.functions.stats import EPS, finite
from alarmspan.layout import Layout
from alarmspan.operators.ordered import ewma, settle, with_totals
from alarmspan.operators.quantile import quantile_table, with_quantiles
from alarmspan.session import cut_lineage

STRATEGIES = ("percentile", "ewma", "evt")


def compute_threshold(train: DataFrame, lay: Layout, strategy: str = "percentile", percentile: float = 97.5,
                      lam: float = 0.2, k: float = 3.0, tail_quantile: float = 0.95, score: str = "score",
                      accuracy: int | None = None) -> DataFrame:
    """``threshold`` per key from training scores (the smoothed limit also needs ``pos`` within the scored set).

    Percentiles are exact unless ``accuracy`` asks for sketches.
    """
    if strategy == "percentile":
        return quantile_table(train, lay, finite(F.col(score)), {"threshold": percentile / 100.0}, accuracy)
    if strategy == "ewma":
        return ewma_threshold(train, lay, lam, k, score)
    if strategy == "evt":
        return evt_threshold(train, lay, tail_quantile, score)
    raise ValueError(f"unknown threshold strategy {strategy!r}; choose one of {STRATEGIES}")


def ewma_threshold(train: DataFrame, lay: Layout, lam: float = 0.2, k: float = 3.0, score: str = "score",
                   pos: str = "pos") -> DataFrame:
    """Mean + k sigma of the smoothed training scores, narrowed by sqrt(lam / (2 - lam)); seeded by the first score."""
    clean = train.where(finite(F.col(score)).isNotNull())
    seeded = with_totals(clean, lay, {"_first": F.min_by(score, pos)})
    smooth = ewma(seeded, lay, F.col(score), lam, F.col("_first"), "_e", pos)
    factor = math.sqrt(lam / (2.0 - lam))
    return smooth.groupBy(*lay.keys).agg(
        (F.avg("_e") + F.lit(k) * (F.stddev_pop("_e") + F.lit(EPS)) * F.lit(factor)).alias("threshold"))


def dynamic_threshold(df: DataFrame, lay: Layout, lam: float = 0.2, k: float = 3.0, warmup: int = 50,
                      score: str = "score", pos: str = "pos") -> DataFrame:
    """A limit for every step: smoothed mean and smoothed variance, both seeded from the first ``warmup`` rows.

    Step 0 keeps the seeds.  The variance is a second scan over the squared distance to the already smoothed mean.
    """
    early = F.when(F.col(pos) < warmup, F.col(score))
    seeded = with_totals(df, lay, {"_mu0": F.avg(early), "_sd0": F.stddev_pop(early)})
    at_start = F.col(pos) == 0
    mean = ewma(seeded, lay, F.when(at_start, F.col("_mu0")).otherwise(F.col(score)), lam, F.col("_mu0"), "ewma_mean", pos)
    mean = settle(mean, lay, "dynamic")
    var0 = F.pow(F.col("_sd0") + F.lit(EPS), F.lit(2.0))
    gap = F.pow(F.col(score) - F.col("ewma_mean"), F.lit(2.0))
    both = ewma(mean, lay, F.when(at_start, var0).otherwise(gap), lam, var0, "ewma_var", pos)
    factor = math.sqrt(lam / (2.0 - lam))
    limit = F.col("ewma_mean") + F.lit(k) * (F.sqrt(F.col("ewma_var")) + F.lit(EPS)) * F.lit(factor)
    return both.withColumn("threshold", limit).drop("_mu0", "_sd0")


# First look: below 0, theta close to the support's end (in powers of the distance) and close to 0; above, powers of ten of
# theta times the mean excess.
_CLOSE, _SMALL, _POSITIVE, _FROM, _TO = 40, 20, 60, -6.0, 9.0


def evt_threshold(train: DataFrame, lay: Layout, tail_quantile: float = 0.95, score: str = "score",
                  points: int = 257, tolerance: float = 1e-9, min_tail: int = 10) -> DataFrame:
    """Tail threshold: generalised Pareto fit above the ``tail_quantile``, its 99 % point; below ten tail scores the
    99th percentile of all scores.

    With theta = shape / scale the likelihood has one free variable.  A first pass compares it over fifteen decades of
    theta per series; then the sign of its derivative narrows the bracket around the best point until it is ``tolerance``
    wide, relative to theta.  A pass is one aggregate over the tail rows, combined before its exchange; whether to go on is
    the one number that reaches the driver.  A tail whose likelihood rises up to an end of the grid keeps that end.
    """
    keys = list(lay.keys)
    clean = train.where(finite(F.col(score)).isNotNull())
    marked = with_quantiles(clean.select(*keys, score), lay, F.col(score), {"_u": tail_quantile, "_p99": 0.99})
    marked = settle(marked, lay, "evt")
    # The passes below re-read the tail and refine a small table: both are written once instead of recomputed.
    tail = cut_lineage(marked.where(F.col(score) > F.col("_u"))
                       .select(*keys, (F.col(score) - F.col("_u")).alias("_x")), "evt-tail")
    base = (marked.groupBy(*keys).agg(F.any_value("_u").alias("_u"), F.any_value("_p99").alias("_p99"))
            .join(tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.avg("_x").alias("_mean"),
                                          F.max("_x").alias("_max")), keys, "left"))
    base = cut_lineage(base, "evt-base")
    fitted = base.where(F.col("_m") >= min_tail).select(*keys, "_mean", "_max")

    def over_tail(grids: DataFrame) -> DataFrame:
        """Shape, and mean of x / (1 + theta x), at every point of the series' array ``_g`` of thetas."""
        spread = tail.join(grids.select(*keys, "_g"), keys).select(*keys, "_x", F.posexplode("_g").alias("_k", "_t"))
        return spread.groupBy(*keys, "_k", "_t").agg(F.avg(F.log1p(F.col("_t") * F.col("_x"))).alias("_xi"),
                                                     F.avg(F.col("_x") / (1.0 + F.col("_t") * F.col("_x"))).alias("_d"))

    def around(points_of: DataFrame, grids: DataFrame, chosen: Column, step: int) -> DataFrame:
        """The bracket of grid points at ``chosen - step`` and ``chosen + 1``, kept inside the grid."""
        picked = points_of.groupBy(*keys).agg(chosen.alias("_i"))
        inside = lambda i: F.get("_g", F.greatest(F.lit(0), F.least(F.size("_g") - 1, i)))
        return cut_lineage(grids.join(picked, keys).select(
            *keys, inside(F.col("_i") - step).alias("_lo"), inside(F.col("_i") + 1).alias("_hi")), "evt-pass")

    first = F.expr(f"""concat(
        transform(sequence(0, {_CLOSE - 1}), k -> (pow(10D, -3D * (1 - k / {float(_CLOSE)}D)) - 1) / _max),
        transform(sequence(1, {_SMALL}), k -> -pow(10D, -1D - 5D * k / {float(_SMALL)}D) / _max),
        transform(sequence(0, {_POSITIVE}), k -> pow(10D, {_FROM}D + {_TO - _FROM}D * k / {float(_POSITIVE)}D) / _mean))""")
    looked = fitted.withColumn("_g", first)
    likelihood = F.when(F.col("_xi") > -1.0, -F.ln(F.col("_xi") / F.col("_t")) - F.col("_xi"))
    state = around(over_tail(looked), looked, F.max_by("_k", likelihood), 1)
    width = F.max((F.col("_hi") - F.col("_lo")) / F.greatest(F.abs("_lo"), F.abs("_hi")))
    steps = F.expr(f"transform(sequence(0, {points - 1}), k -> _lo + (_hi - _lo) * k / {float(points - 1)}D)")
    # Theta times the derivative by theta; the last point where the likelihood still rises opens the new bracket.  Shapes
    # of -1 and below have no likelihood, so what rises towards them ends at -1.
    rising = (F.col("_xi") <= -1.0) | ((1.0 - F.col("_t") * F.col("_d") * (1.0 / F.col("_xi") + 1.0)) * F.signum("_t") > 0)
    while (state.agg(width).first()[0] or 0.0) > tolerance:
        grid = state.withColumn("_g", steps)
        state = around(over_tail(grid), grid, F.coalesce(F.max(F.when(rising, F.col("_k"))), F.lit(-1)), 0)
    shapes = over_tail(state.withColumn("_g", F.array((F.col("_lo") + F.col("_hi")) / 2))).select(
        *keys, F.col("_xi").alias("shape"), (F.col("_xi") / F.col("_t")).alias("scale"))
    quantile = F.col("scale") / F.col("shape") * (F.pow(F.lit(0.01), -F.col("shape")) - 1.0)
    return base.join(shapes, keys, "left").select(
        *keys, F.when(quantile.isNotNull(), F.col("_u") + quantile).otherwise(F.col("_p99")).alias("threshold"),
        "shape", "scale", F.coalesce("_m", F.lit(0)).alias("tail_rows"))
