"""Experiment settings, passed explicitly to the plans that need them."""
from __future__ import annotations

from dataclasses import dataclass, field

# The published defaults of the method this package reproduces.


@dataclass(frozen=True)
class FeatureConfig:
    window_size: int = 10
    overlap: float = 0.5
    feature_list: tuple[str, ...] = (
        "rms", "kurtosis", "crest_factor", "skewness", "peak_to_peak", "shape_factor", "variance")
    include_cross_channel: bool = True


@dataclass(frozen=True)
class SplitConfig:
    train_fraction: float = 0.50
    calibration_fraction: float = 0.10
    normal_period_fraction: float = 0.05


@dataclass(frozen=True)
class ThresholdConfig:
    strategy: str = "percentile"
    percentile: float = 97.5
    ewma_lambda: float = 0.2
    ewma_k: float = 3.0
    evt_quantile: float = 0.95
    persistence: int = 3
    sweep_percentiles: tuple[float, ...] = (90.0, 92.5, 95.0, 97.5, 99.0, 99.5)


@dataclass(frozen=True)
class SamplingConfig:
    factors: tuple[int, ...] = (1, 2, 5, 10, 20)
    modes: tuple[str, ...] = ("aggregate", "decimate")
    min_window_rows: int = 3
    window_minutes: float | None = None
    persistence_minutes: float | None = None


@dataclass(frozen=True)
class UncertaintyConfig:
    n_bootstraps: int = 30
    ci_alpha: float = 0.10
    conformal_alpha: float = 0.05
    random_state: int = 42


@dataclass(frozen=True)
class ModelConfig:
    methods: tuple[str, ...] = ("three_sigma", "ewma", "hotelling_t2", "isolation_forest")
    params: dict = field(default_factory=lambda: {
        "isolation_forest": {"n_estimators": 200, "random_state": 42},
        "one_class_svm": {"nu": 0.05},
        "three_sigma": {"n_sigma": 3.0},
        "ewma": {"lambda_": 0.2, "k": 3.0},
        "hotelling_t2": {"alpha": 0.01, "n_components": 10},
        "sequence_ae": {"seq_len": 30, "latent_dim": 16},
    })


@dataclass(frozen=True)
class ExperimentConfig:
    features: FeatureConfig = FeatureConfig()
    split: SplitConfig = SplitConfig()
    threshold: ThresholdConfig = ThresholdConfig()
    sampling: SamplingConfig = SamplingConfig()
    uncertainty: UncertaintyConfig = UncertaintyConfig()
    models: ModelConfig = field(default_factory=ModelConfig)
