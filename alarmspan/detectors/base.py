"""What a detector is: a fit that yields a parameter table and a score that joins it back."""
from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.layout import Layout

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Detector:
    """``fit(train, layout) -> parameter table keyed like the layout``;
    ``score(rows, parameters, layout) -> rows + score`` (higher is more anomalous).

    Rows carry ``pos`` (position inside the scored set) and the feature columns or array the detector was built for.
    """
    name: str
    short_name: str
    fit: Callable[[DataFrame, Layout], DataFrame]
    score: Callable[[DataFrame, DataFrame, Layout], DataFrame]

    def fit_score(self, train: DataFrame, rows: DataFrame, lay: Layout) -> DataFrame:
        return self.score(rows, self.fit(train, lay), lay)

    def score_splits(self, df: DataFrame, lay: Layout) -> DataFrame:
        """Fit on ``split = 'train'`` and score every split as a set of its own."""
        each = lay.by("split")
        rows = df.withColumn("pos", F.col("split_pos")) if "split_pos" in df.columns else df
        params = self.fit(rows.where("split = 'train'"), lay)
        return self.score(rows, params, each).withColumn("method", F.lit(self.short_name))


def normalised(df: DataFrame, lay: Layout, score: str = "score", out: str = "score_norm") -> DataFrame:
    from alarmspan.operators.scale import minmax_normalise
    return minmax_normalise(df, lay, score, out)


_FACTORIES: dict[str, Callable[..., Detector]] = {}


def register_detector(name: str, factory: Callable[..., Detector]) -> None:
    """Add a detector factory; ``factory(features, **params)``."""
    _FACTORIES[name] = factory


def build_detectors(methods, features, params: dict | None = None, strict: bool = False) -> list[Detector]:
    """Detectors by name; an unknown name is reported and skipped, or (``strict``) an error."""
    import alarmspan.detectors.forest  # noqa: F401  registers its factory
    import alarmspan.detectors.pca  # noqa: F401
    import alarmspan.detectors.rff  # noqa: F401
    import alarmspan.detectors.statistical  # noqa: F401
    made = []
    for name in methods:
        if name not in _FACTORIES:
            if strict:
                raise ValueError(f"unknown method {name!r}; choose among {sorted(_FACTORIES)}")
            log.warning("unknown method %r skipped", name)
            continue
        made.append(_FACTORIES[name](features, **((params or {}).get(name, {}))))
    return made
