"""Sampling-rate sweep: every (mode, factor) is a key of one job rather than a loop of jobs."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.detectors.base import build_detectors
from alarmspan.config import FeatureConfig, SamplingConfig, SplitConfig, ThresholdConfig
from alarmspan.functions.timeparse import hours_between
from alarmspan.layout import Layout
from alarmspan.operators.features import common_divisor, design_matrix, feature_columns, rolling_features
from alarmspan.operators.metrics import normalised_lead
from alarmspan.operators.ordered import settle, with_position, with_totals
from alarmspan.operators.quantile import quantile_table
from alarmspan.operators.resample import MINUTE_US, bin_start, derive_counts, median_spacing
from alarmspan.operators.scale import apply_scaler, fit_scaler
from alarmspan.session import cut_lineage
from alarmspan.plans.evaluate import CLOSED_FORM, closed_form_scores, evaluate_scores, model_scores, split_rows

RATE_KEYS = ("mode", "factor")


def rate_table(df: DataFrame, lay: Layout, sampling: SamplingConfig = SamplingConfig(),
               features: FeatureConfig = FeatureConfig(), threshold: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """One row per series, mode and factor with the counts that hold window and persistence constant in time.

    Durations default to the base grid's, so factor 1 is the plain pipeline.  Needs ``pos``.
    """
    base = median_spacing(df, lay).where(F.col("spacing_min") > 0)
    window = F.lit(sampling.window_minutes) if sampling.window_minutes else F.lit(features.window_size) * F.col("spacing_min")
    hold = (F.lit(sampling.persistence_minutes) if sampling.persistence_minutes else
            F.lit(threshold.persistence * features.window_size * (1.0 - features.overlap)) * F.col("spacing_min"))
    rates = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(f).cast("long").alias("factor"))
                                for m in sampling.modes for f in sampling.factors]))
    grid = base.select(*lay.keys, "spacing_min", rates.alias("_r")).select(*lay.keys, "spacing_min", "_r.*")
    return derive_counts(grid, F.col("spacing_min"), F.col("factor"), window, hold, features.overlap, sampling.min_window_rows)


def at_every_rate(df: DataFrame, lay: Layout, rates: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of each series at each rate, numbered (``pos``, ``n``): means over coarser bins, or every k-th row.

    The fan-out is the number of rates.  Aggregated bins combine before the exchange; factor 1 keeps the rows as they
    are in both modes.  Rows that are kept have their new number from the old one; only bins are numbered anew.  Needs
    ``pos`` and ``n``.
    """
    keys = list(lay.keys)
    first = with_totals(df, lay, {"_first": F.min(lay.order)})
    options = rates.groupBy(*keys).agg(F.collect_list(F.struct(*RATE_KEYS, "spacing_min")).alias("_rates"))
    spread = (first.join(options, keys).withColumn("_r", F.explode("_rates")).drop("_rates")
              .select("*", "_r.mode", "_r.factor", "_r.spacing_min"))
    kept = (F.col("factor") == 1) | ((F.col("mode") == "decimate") & (F.col("pos") % F.col("factor") == 0))
    place = {"pos": F.floor(F.col("pos") / F.col("factor")), "n": F.ceil(F.col("n") / F.col("factor"))}
    same = spread.where(kept).select(*keys, *RATE_KEYS, lay.order, "failure_time", *cols,
                                     *[c.cast("long").alias(k) for k, c in place.items()])
    minutes = F.greatest(F.lit(1).cast("long"), F.bround(F.col("spacing_min") * F.col("factor")).cast("long"))
    coarse = (spread.where((F.col("factor") > 1) & (F.col("mode") == "aggregate"))
              .withColumn("_bin", bin_start(F.col(lay.order), F.col("_first"), minutes * MINUTE_US))
              .groupBy(*keys, *RATE_KEYS, F.col("_bin").alias(lay.order))
              .agg(F.any_value("failure_time").alias("failure_time"), *[F.avg(c).alias(c) for c in cols])
              .dropna("all", subset=cols))
    return same.unionByName(with_position(coarse, lay.by(*RATE_KEYS)))


def sampling_sweep(df: DataFrame, lay: Layout, channels: list[str], sampling: SamplingConfig = SamplingConfig(),
                   features: FeatureConfig = FeatureConfig(), split: SplitConfig = SplitConfig(),
                   threshold: ThresholdConfig = ThresholdConfig(), scale: bool = True,
                   methods: Sequence[str] = CLOSED_FORM, options: dict | None = None) -> DataFrame:
    """Metrics per series, mode, factor and method, with lead normalised by the longest achievable one.

    ``methods``: any registered detectors; the closed-form ones share one pass, others are fitted per series and rate, with ``options`` by name.
    """
    keys = list(lay.keys)
    # Tables read more than once below are written once instead of being derived again for each reading.
    placed = settle(with_position(df, lay), lay, "sweep-rows")
    rates = cut_lineage(rate_table(placed, lay, sampling, features, threshold), "rates")
    rated = lay.by(*RATE_KEYS)
    rows = cut_lineage(at_every_rate(placed, lay, rates, channels), "sweep-rates")
    spacing = median_spacing(rows, rated).withColumnRenamed("spacing_min", "effective_interval_min")
    counts = rates.select(*keys, *RATE_KEYS, "window_rows", "persistence_windows", "window_floored")
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("window_rows") * F.lit(1.0 - features.overlap)).cast("long"))
    sized = counts.withColumn("_step", step).withColumn("_gcd", common_divisor(F.col("window_rows"), F.col("_step")))
    longest = rates.agg(F.max("window_rows")).first()[0]
    windows = rolling_features(rows.join(sized, [*keys, *RATE_KEYS]), rated, channels, F.col("window_rows"), features.overlap,
                               features.feature_list, features.include_cross_channel, F.col("_step"),
                               keep=("failure_time", "window_rows", "persistence_windows", "window_floored", "n", "_step"), pane=F.col("_gcd"), longest=longest)
    cols = feature_columns(channels, features.feature_list, features.include_cross_channel)
    # Windows are numbered in time order as they are made.  Calibration rows enter no scale, fit, threshold or alarm here.
    numbered = windows.withColumns({"pos": F.col("w"), "n": F.floor((F.col("n") - F.col("window_rows")) / F.col("_step")) + 1})
    tagged = cut_lineage(split_rows(numbered, split).where("split <> 'cal'").drop("w", "pos", "n", "_step"), "sweep-windows")
    if scale:
        params = fit_scaler(tagged, rated, cols, "robust", F.col("split") == "train")
        tagged = apply_scaler(tagged, params, rated, cols)
    plain = [m for m in methods if m in CLOSED_FORM]
    scored = closed_form_scores(tagged, rated, cols, plain).drop(*cols) if plain else None
    fitted = [m for m in methods if m not in CLOSED_FORM]
    if fitted:
        rows = cut_lineage(design_matrix(tagged, cols).drop(*cols), "sweep-features")
        modelled = model_scores(rows, rated, build_detectors(fitted, "features", options, strict=True), strict=True).join(counts, [*keys, *RATE_KEYS])
        same = [c for c in modelled.columns if scored is None or c in scored.columns]
        scored = modelled if scored is None else scored.select(*same).unionByName(modelled.select(*same))
    result = evaluate_scores(scored, rated.by("method"), threshold, split.normal_period_fraction,
                             F.col("persistence_windows"),
                             extra=("window_rows", "persistence_windows", "window_floored"))
    result = result.join(spacing, [*keys, *RATE_KEYS])
    # The longest achievable lead is anchored to the full-rate test grid of the series: a group is its handful of rows
    # here, one per mode, factor and method.
    per_series = len(sampling.modes) * len(sampling.factors) * len(methods)
    anchor = with_totals(result, replace(lay, max_rows=per_series, block_rows=max(per_series, lay.block_rows)), {
        "available_lead_hours": F.max(F.when(F.col("factor") == 1, hours_between(F.col("failure_time"), F.col("normal_end"))))})
    vlt = F.round("vlt_hours", 2)
    return anchor.select(
        *keys, *RATE_KEYS, "method", F.round("effective_interval_min", 2).alias("effective_interval_min"),
        vlt.alias("vlt_hours"), F.round(normalised_lead(vlt, F.col("available_lead_hours")), 4).alias("vlt_norm"),
        F.when(F.col("available_lead_hours") > 0, F.round("available_lead_hours", 2)).alias("available_lead_hours"),
        F.round("far_pct", 2).alias("far_pct"), "fat", "valid_alarm", F.col("n_test").alias("n_test_windows"),
        "window_rows", "persistence_windows", "window_floored")


def sampling_aggregate(sweep: DataFrame, lay: Layout, by: tuple[str, ...] = ("mode", "factor", "effective_interval_min", "method")) -> DataFrame:
    """Spread of lead and false-alarm rate across series per rate and method; a single series has deviation 0."""
    spread = lambda c, o: [F.avg(c).alias(f"{o}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{o}_std")]
    moments = sweep.groupBy(*by).agg(
        *spread("vlt_hours", "VLT_hours"), *spread("vlt_norm", "VLT_norm"), *spread("far_pct", "FAR_pct"),
        F.min("vlt_norm").alias("VLT_norm_min"), F.max("vlt_norm").alias("VLT_norm_max"),
        F.count_distinct(*lay.keys).alias("n_runs"))
    # A fleet is one group here, so its medians take the distributed path whatever the length of a series.
    fleet = replace(lay, keys=tuple(by) + ("measure",), max_rows=None)
    long = sweep.select(*by, F.explode(F.array(*[
        F.struct(F.lit(o).alias("measure"), F.col(c).alias("x"))
        for c, o in (("vlt_hours", "VLT_hours"), ("vlt_norm", "VLT_norm"), ("far_pct", "FAR_pct"))])).alias("_x")) \
        .select(*by, "_x.measure", "_x.x")
    medians = quantile_table(long, fleet, F.col("x"), {"median": 0.5})
    wide = medians.groupBy(*by).agg(*[
        F.max(F.when(F.col("measure") == o, F.col("median"))).alias(f"{o}_median") for o in ("VLT_hours", "VLT_norm", "FAR_pct")])
    return moments.join(wide, list(by))
