"""Bootstrap intervals and conformal p-values around any detector."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.detectors.base import Detector
from alarmspan.functions.stats import EPS
from alarmspan.layout import Layout
from alarmspan.operators.alarms import persistence_filter
from alarmspan.operators.ordered import settle, with_totals
from alarmspan.operators.quantile import value_cell

_PRIME = 2_147_483_647  # modulus of the integer draw


def integer_draw(b: Column, i: Column, n: Column, seed: int = 42) -> Column:
    """Pseudo-random position in [0, n) for draw ``i`` of resample ``b``, in exact 64-bit integer arithmetic."""
    x = F.pmod(b * 7_919_777 + i * 104_729 + F.lit(seed + 1), F.lit(_PRIME))
    x = F.pmod(F.pmod(x * x, F.lit(_PRIME)) * 48_271 + x * 69_621, F.lit(_PRIME))
    x = F.pmod(F.pmod(x * x, F.lit(_PRIME)) * 16_807 + x, F.lit(_PRIME))
    return F.pmod(x, n)


def bootstrap_weights(train: DataFrame, lay: Layout, n_bootstraps: int = 30, seed: int = 42) -> DataFrame:
    """How often each training row is drawn in each resample: (keys, b, pos, weight).

    Row i of the training part makes draw i of every resample, so draws are produced where the rows are; equal draws
    are counted before they are exchanged by (series, b, pos), which no series can crowd.  Needs ``split_pos`` and
    ``split_n``.
    """
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bootstraps - 1).cast("long"))).alias("b")
    draws = train.select(*lay.keys, F.col("split_pos").alias("i"), F.col("split_n").alias("m"), b)
    drawn = draws.select(*lay.keys, "b", integer_draw(F.col("b"), F.col("i"), F.col("m"), seed).alias("split_pos"))
    return drawn.groupBy(*lay.keys, "b", "split_pos").agg(F.count(F.lit(1)).alias("weight"))


def bootstrap_rows(train: DataFrame, lay: Layout, n_bootstraps: int = 30, seed: int = 42) -> DataFrame:
    """Resampled training rows for detectors that need the rows themselves: keyed with ``b``, ``pos`` is the draw."""
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bootstraps - 1).cast("long"))).alias("b")
    draws = train.select(*lay.keys, F.col("split_pos").alias("_i"), F.col("split_n").alias("_m"), b)
    drawn = draws.select(*lay.keys, "b", "_i", integer_draw(F.col("b"), F.col("_i"), F.col("_m"), seed).alias("split_pos"))
    return train.join(drawn, [*lay.keys, "split_pos"]).withColumn("pos", F.col("_i")).drop("_i")


def bootstrap_fit(detector: Detector, train: DataFrame, lay: Layout, n_bootstraps: int = 30, seed: int = 42) -> DataFrame:
    """Parameters of one model per resample: the detector's own fit, keyed by (series, b)."""
    return detector.fit(bootstrap_rows(train, lay, n_bootstraps, seed), lay.by("b"))


def bootstrap_scores(detector: Detector, params: DataFrame, rows: DataFrame, lay: Layout, n_bootstraps: int = 30) -> DataFrame:
    """Every row scored by every model, long: adds ``b`` and ``score``."""
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bootstraps - 1).cast("long")))
    return detector.score(rows.withColumn("b", b), params, lay.by("b"))


def bootstrap_interval(scores: DataFrame, lay: Layout, alpha: float = 0.10, score: str = "score") -> DataFrame:
    """Mean score and percentile interval over the models; a group is one row's B scores."""
    return scores.groupBy(*lay.keys, lay.order).agg(
        F.avg(score).alias("mean_score"), F.percentile(score, F.lit(alpha / 2)).alias("lower"),
        F.percentile(score, F.lit(1 - alpha / 2)).alias("upper"))


def weighted_moments_interval(df: DataFrame, lay: Layout, index: Column, n_bootstraps: int = 30, alpha: float = 0.10,
                              seed: int = 42) -> DataFrame:
    """Bootstrap interval of the three-sigma score without repeating rows: resample weights enter the moments, the B
    parameter pairs of a series travel as one array, and the interval is read off that array in the row itself."""
    keys = list(lay.keys)
    # Scores do not change when the index is shifted; near its training mean the squares below lose no digits.
    anchor = F.avg(F.when(F.col("split") == "train", F.col("_h")))
    rows = with_totals(df.withColumn("_h", index), lay, {"_anchor": anchor})
    rows = settle(rows.withColumn("_h", F.col("_h") - F.col("_anchor")).drop("_anchor"), lay, "bootstrap")
    train = rows.where("split = 'train'")
    weights = bootstrap_weights(train, lay, n_bootstraps, seed)
    drawn = train.select(*keys, "split_pos", "_h").join(weights, [*keys, "split_pos"])
    w, h = F.col("weight").cast("double"), F.col("_h")
    mean = drawn.groupBy(*keys, "b").agg((F.sum(w * h) / F.sum(w)).alias("mu"), (F.sum(w * h * h) / F.sum(w)).alias("m2"))
    models = mean.groupBy(*keys).agg(F.collect_list(F.struct(
        "mu", (F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("mu") * F.col("mu"))) + F.lit(EPS)).alias("sd"))).alias("_models"))
    scored = rows.join(models, keys).withColumn(
        "_all", F.sort_array(F.transform("_models", lambda m: F.abs((F.col("_h") - m["mu"]) / m["sd"]))))
    def at(p: float) -> Column:
        rank = F.lit(p) * (F.size("_all") - 1)
        low = F.floor(rank).cast("int")
        high = F.ceil(rank).cast("int")
        a, b = F.get("_all", low), F.get("_all", high)
        return a + (b - a) * (rank - low)
    total = F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + x)
    return scored.withColumns({"mean_score": total / F.size("_all"), "lower": at(alpha / 2), "upper": at(1 - alpha / 2)}) \
                 .drop("_h", "_models", "_all")


def conformal_pvalues(scored: DataFrame, lay: Layout, score: str = "score") -> DataFrame:
    """p = number of calibration scores >= s, over (n_cal + 1), for the test rows (``split``: cal, test).

    Whole layout: a running count down the scores, peers included.  Otherwise counts per value cell are summed down
    the cells and only the row's own cell is sorted.
    """
    keys = list(lay.keys)
    both = scored.where(F.col("split").isin("cal", "test")).withColumn("_cal", (F.col("split") == "cal").cast("long"))
    if lay.whole:
        down = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rangeBetween(Window.unboundedPreceding, 0)
        counted = both.withColumns({"_above": F.sum("_cal").over(down),
                                    "n_cal": F.sum("_cal").over(Window.partitionBy(*keys))})
    else:
        both = settle(both.withColumn("_cell", value_cell(F.col(score))), lay, "conformal")
        cells = both.groupBy(*keys, "_cell").agg(F.sum("_cal").alias("_c"))
        over = Window.partitionBy(*keys).orderBy(F.col("_cell").desc())
        cells = cells.select(*keys, "_cell", (F.sum("_c").over(over) - F.col("_c")).alias("_higher"),
                             F.sum("_c").over(Window.partitionBy(*keys)).alias("n_cal"))
        # Distinct scores per cell, so that a score repeated through the series is one row of the sort.
        values = both.groupBy(*keys, "_cell", score).agg(F.sum("_cal").alias("_c"))
        within = Window.partitionBy(*keys, "_cell").orderBy(F.col(score).desc())
        placed = values.select(*keys, "_cell", score, F.sum("_c").over(within).alias("_in"))
        counted = (both.join(placed, [*keys, "_cell", score]).join(cells, [*keys, "_cell"])
                       .withColumn("_above", F.col("_in") + F.col("_higher")).drop("_cell", "_in", "_higher"))
    p = F.col("_above").cast("double") / (F.col("n_cal") + 1)
    return counted.where("split = 'test'").withColumn("p_value", p).drop("_cal", "_above")


def conformal_calibrate(detector: Detector, df: DataFrame, lay: Layout) -> DataFrame:
    """Fit on train, score the calibration and test parts."""
    return detector.score_splits(df, lay).where(F.col("split").isin("cal", "test"))


def conformal_alarm(pvalues: DataFrame, lay: Layout, alpha: float = 0.05, persistence: int = 3) -> DataFrame:
    return persistence_filter(settle(pvalues, lay, "pvalues"), lay, F.col("p_value") < alpha, persistence, pos="split_pos")


def calibration_table(pvalues: DataFrame, alphas: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20),
                      keys: Sequence[str] = ()) -> DataFrame:
    """Achieved false-alarm rate on normal rows for each target level."""
    levels = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    return (pvalues.select(*keys, "p_value", levels).groupBy(*keys, "alpha")
            .agg(F.avg((F.col("p_value") < F.col("alpha")).cast("double")).alias("actual_far"), F.count(F.lit(1)).alias("n_rows")))
