"""End-to-end plans: processed rows to scaled feature windows, experiments, and comparisons across feature scales."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.config import ExperimentConfig
from alarmspan.detectors.base import build_detectors
from alarmspan.layout import Layout
from alarmspan.operators.clean import impute_mean
from alarmspan.operators.features import design_matrix, feature_columns, multiscale_features, rolling_features
from alarmspan.operators.ordered import settle, with_position
from alarmspan.operators.resample import decimate, median_spacing, resample_mean
from alarmspan.operators.scale import apply_scaler, fit_scaler
from alarmspan.session import cut_lineage
from alarmspan.plans.evaluate import evaluate_scores, model_scores, split_rows, summary


def reduce_rate(df: DataFrame, lay: Layout, channels: Sequence[str], factor: int = 1, mode: str = "none") -> DataFrame:
    """Coarser grid before feature extraction (needs ``pos``): mean over bins, every k-th row, or unchanged."""
    if mode not in ("none", "aggregate", "decimate"):
        raise ValueError(f"unknown rate reduction {mode!r}")
    if mode == "none" or factor <= 1:
        return df.drop("pos", "n")
    if mode == "decimate":
        return decimate(df, factor).drop("pos", "n")
    cols = [*channels, *[c for c in ("hours_to_failure",) if c in df.columns]]
    spacing = median_spacing(df, lay)
    minutes = F.greatest(F.lit(1).cast("long"), F.bround(F.col("spacing_min") * F.lit(float(factor))).cast("long"))
    return resample_mean(df.join(spacing, list(lay.keys)), lay, cols, minutes)


def feature_pipeline(df: DataFrame, lay: Layout, channels: Sequence[str], cfg: ExperimentConfig = ExperimentConfig(),
                     factor: int = 1, mode: str = "none", window: int | None = None, overlap: float | None = None) -> tuple[DataFrame, list[str]]:
    """(split, imputed, scaled feature windows; their feature names).  An overlap of 0 is honoured."""
    window = cfg.features.window_size if window is None else window
    overlap = cfg.features.overlap if overlap is None else overlap
    placed = settle(with_position(df, lay), lay, "rows")
    rows = placed if mode == "none" or factor <= 1 else settle(with_position(reduce_rate(placed, lay, channels, factor, mode), lay), lay, "reduced")
    windows = rolling_features(rows, lay, channels, window, overlap, cfg.features.feature_list, cfg.features.include_cross_channel)
    names = feature_columns(channels, cfg.features.feature_list, cfg.features.include_cross_channel)
    return prepare(windows, lay, names, cfg), names


def prepare(windows: DataFrame, lay: Layout, names: Sequence[str], cfg: ExperimentConfig) -> DataFrame:
    """Split feature rows in order, impute per split, scale robustly on the training part, assemble the array."""
    tagged = settle(split_rows(with_position(windows, lay), cfg.split), lay, "windows")
    whole = settle(impute_mean(tagged, lay, list(names)), lay, "imputed")
    params = fit_scaler(whole, lay, list(names), "robust", F.col("split") == "train")
    return design_matrix(apply_scaler(whole, params, lay, list(names)), list(names))


def run_experiment(df: DataFrame, lay: Layout, channels: Sequence[str], runs: DataFrame, cfg: ExperimentConfig = ExperimentConfig(),
                   **options) -> DataFrame:
    """Every configured method on every series: metrics, best lead first."""
    rows, _ = feature_pipeline(df, lay, channels, cfg, **options)
    return summary(compare_methods(rows, lay, runs, cfg))


def compare_methods(rows: DataFrame, lay: Layout, runs: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    keep = [*lay.keys, lay.order, "pos", "n", "split", "split_pos", "split_n", "features"]
    known = rows.select(*keep).join(runs.select("series_id", "failure_time"), "series_id")
    known = settle(known, lay, "features")
    scores = model_scores(known, lay, build_detectors(cfg.models.methods, "features", cfg.models.params, strict=True), strict=True)
    return evaluate_scores(scores, lay.by("method"), cfg.threshold, cfg.split.normal_period_fraction)


def scale_metrics(df: DataFrame, lay: Layout, channels: Sequence[str], runs: DataFrame, scales: dict[str, Sequence[int]],
                   cfg: ExperimentConfig = ExperimentConfig(), tolerance_seconds: float = 300.0) -> DataFrame:
    """Method x feature-scale table: a scale is one window size, or several fused onto the coarsest grid."""
    placed = settle(with_position(df, lay), lay, "rows")
    out = None
    for label, sizes in scales.items():
        if len(sizes) == 1:
            windows = rolling_features(placed, lay, channels, sizes[0], cfg.features.overlap, cross_channel=False)
            names = feature_columns(channels, cross_channel=False)
        else:
            windows = multiscale_features(placed, lay, channels, sizes, cfg.features.overlap, tolerance_seconds=tolerance_seconds)
            names = [c for c in windows.columns if "_w" in c]
        part = compare_methods(prepare(windows, lay, names, cfg), lay, runs, cfg).withColumn("scale", F.lit(label))
        part = cut_lineage(part, "scale")  # a few rows per series; the experiments do not depend on each other
        out = part if out is None else out.unionByName(part)
    return out


def compare_scales(df: DataFrame, lay: Layout, channels: Sequence[str], runs: DataFrame, scales: dict[str, Sequence[int]],
                   cfg: ExperimentConfig = ExperimentConfig(), tolerance_seconds: float = 300.0) -> DataFrame:
    """``scale_metrics`` in reported form: rounded, best lead first."""
    return summary(scale_metrics(df, lay, channels, runs, scales, cfg, tolerance_seconds))
