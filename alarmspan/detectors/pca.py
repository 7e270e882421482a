"""Principal subspaces per series: T-squared scores and sequence reconstruction error."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.detectors.base import Detector, register_detector
from alarmspan.detectors.chunks import CHUNK_ROWS, matrix_of, per_chunk, per_halo_chunk, summed_by_series
from alarmspan.functions.stats import EPS
from alarmspan.functions.tails import chi2_limit
from alarmspan.layout import Layout
from alarmspan.operators.ordered import settle, with_totals
from alarmspan.session import cut_lineage

# Rows of a chunk whose sequences are formed in one task.
SEQUENCE_CHUNK = 4_096


class PlainRows:
    """Rows of a series as they are: what range finding needs to know of its matrix."""
    before = 0

    def count(self, x: np.ndarray) -> int:
        return len(x)

    def total(self, x: np.ndarray) -> np.ndarray:
        return x.sum(axis=0)

    def product(self, x: np.ndarray, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
        """C q, where C sums the outer products of the rows off their mean."""
        x = x - mean
        return x.T @ (x @ q)


class SequenceRows:
    """Overlapping sequences of ``length`` rows, flattened, without writing them down.

    Row i of the matrix is rows i .. i + length - 1 of the series side by side, so a product with it is ``length`` products
    with shifted views of the rows themselves.
    """
    def __init__(self, length: int):
        self.length, self.before = length, length - 1

    def _shifts(self, x: np.ndarray) -> list[np.ndarray]:
        n = self.count(x)
        return [x[j:j + n] for j in range(self.length)]

    def count(self, x: np.ndarray) -> int:
        return max(0, len(x) - self.before)

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([part.sum(axis=0) for part in self._shifts(x)])

    def product(self, x: np.ndarray, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
        p = x.shape[1]
        parts = [part - mean[j * p:(j + 1) * p] for j, part in enumerate(self._shifts(x))]
        z = sum(part @ q[j * p:(j + 1) * p] for j, part in enumerate(parts))
        return np.concatenate([part.T @ z for part in parts])


def fit_subspace(train: DataFrame, lay: Layout, k: int, features: str = "features", spare_rows: int = 2, rows: PlainRows | SequenceRows = PlainRows(),
                 extra: int = 54, passes: int = 30, tolerance: float = 1e-7, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Leading principal directions per series: (keys, n_train, k, mean, components, spread, residual).

    Randomised range finding: a basis of k + ``extra`` directions, random at first, is multiplied by the covariance once a
    pass and made orthonormal.  A pass adds a p x (k + extra) block per task, never p x p, and the directions are those of
    the covariance inside the basis.  Passes end when no series' kept directions leave a residual above ``tolerance`` times
    its largest eigenvalue (the eigenvalues are off by no more than that), or after ``passes``; ``residual`` says what was
    reached.  Where k + extra reaches p the basis is the whole space and one pass is exact.  k is at most n - spare_rows.
    Series without a row give none.
    """
    keys = list(lay.keys)
    fields = {f.name: f for f in train.schema.fields}
    head = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in keys)
    schema = f"{head}, n bigint, mean binary, basis binary, values binary, residual double, width int"

    def start(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                v = np.frombuffer(row["total"])
                if v[0] < 1:
                    continue
                p = len(v) - 1
                width = min(p, k + extra)
                q = np.eye(p) if width == p else np.linalg.qr(np.random.default_rng(42).normal(size=(p, width)))[0]
                out.append((*[row[c] for c in keys], int(v[0]), (v[1:] / v[0]).tobytes(), q.tobytes(), b"", np.inf, width))
            yield pd.DataFrame(out, columns=[*keys, "n", "mean", "basis", "values", "residual", "width"])

    def turn(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                width, n = int(row["width"]), int(row["n"])
                q = np.frombuffer(row["basis"]).reshape(-1, width)
                y = np.frombuffer(row["total"]).reshape(-1, width) / n
                inside = q.T @ y
                values, turned = np.linalg.eigh((inside + inside.T) / 2)
                values, turned = values[::-1], turned[:, ::-1]
                kept = int(max(1, min(k, n - spare_rows, len(q))))
                axes = q @ turned
                rest = np.linalg.norm(y @ turned[:, :kept] - axes[:, :kept] * values[:kept], axis=0).max()
                residual = float(rest / max(values[0], np.finfo(float).tiny))
                done = residual <= tolerance or width == len(q)
                basis = axes if done else np.linalg.qr(y @ turned)[0]
                out.append((*[row[c] for c in keys], n, row["mean"], basis.tobytes(), values.tobytes(), residual if width < len(q) else 0.0, width))
            yield pd.DataFrame(out, columns=[*keys, "n", "mean", "basis", "values", "residual", "width"])

    def read(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                width, n = int(row["width"]), int(row["n"])
                axes = np.frombuffer(row["basis"]).reshape(-1, width)
                values = np.frombuffer(row["values"])
                kept = int(max(1, min(k, n - spare_rows, len(axes))))
                out.append((*[row[c] for c in keys], n, kept, np.frombuffer(row["mean"]), axes[:, :kept].T.ravel(),
                            np.sqrt(np.clip(values[:kept], 0.0, None)), row["residual"]))
            yield pd.DataFrame(out, columns=[*keys, "n_train", "k", "mean", "components", "spread", "residual"])

    def summed(partial, state=None):
        return summed_by_series(train, keys, partial, features, state, rows.before, chunk_rows)

    def sizes(x, _):
        return np.concatenate([[float(rows.count(x))], rows.total(x)])

    def block(x, own):
        width = int(own["width"])
        q, mean = np.frombuffer(own["basis"]).reshape(-1, width), np.frombuffer(own["mean"])
        return rows.product(x, mean, q).ravel()

    state = cut_lineage(summed(sizes).mapInPandas(start, schema), "subspace")
    for _ in range(passes):
        turned = summed(block, state).join(state, keys).mapInPandas(turn, schema)
        state = cut_lineage(turned, "subspace")
        worst = state.agg(F.max("residual")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.mapInPandas(read, f"{head}, n_train bigint, k bigint, mean array<double>, components array<double>, "
                                   "spread array<double>, residual double")


def hotelling_t2(features: str = "features", alpha: float = 0.01, n_components: int = 10) -> Detector:
    """Squared distance from the training mean inside the leading subspace, each direction in its own deviations.

    Projections of the training rows are centred and their deviations are the roots of the eigenvalues, so both come
    from the decomposition; directions may flip sign without changing the score.
    """
    def fit(train: DataFrame, lay: Layout) -> DataFrame:
        return cut_lineage(fit_subspace(train, lay, n_components, features), "t2")

    def compute(rows: pd.DataFrame, params: pd.DataFrame) -> dict:
        p = params.iloc[0]
        mean = np.asarray(p["mean"], dtype=float)
        axes = np.asarray(p["components"], dtype=float).reshape(int(p["k"]), -1)
        z = (matrix_of(rows[features]) - mean) @ axes.T / (np.asarray(p["spread"], dtype=float) + EPS)
        return {"score": (z * z).sum(axis=1)}

    def score(rows: DataFrame, params: DataFrame, lay: Layout) -> DataFrame:
        return per_chunk(rows, params, lay.keys, compute, {"score": "double"}, drop=(features,))

    return Detector("Hotelling T²", "hotelling_t2", fit, score)


def t2_limit(params: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Chi-squared control limit of fitted T-squared models, degrees of freedom = retained rank."""
    return params.withColumn("limit", chi2_limit(F.col("k"), alpha))


def _scale_elements(rows: DataFrame, bounds: DataFrame, lay: Layout, features: str) -> DataFrame:
    shared = [k for k in lay.keys if k in bounds.columns]
    unit = F.zip_with(features, "_bounds", lambda x, b: (x - b["lo"]) / F.when(b["hi"] == b["lo"], F.lit(1.0)).otherwise(b["hi"] - b["lo"]))
    return rows.join(bounds, shared).withColumn(features, unit).drop("_bounds")


def sequence_ae(features: str = "features", seq_len: int = 30, latent_dim: int = 16, **_ignored) -> Detector:
    """Reconstruction error of overlapping sequences under a linear autoencoder of ``latent_dim`` (a principal
    subspace of the flattened, min-max scaled training sequences); earlier rows get the series' smallest error."""
    def fit(train: DataFrame, lay: Layout) -> DataFrame:
        keys = list(lay.keys)
        items = train.select(*keys, F.posexplode(features).alias("_i", "_x"))
        ranges = items.groupBy(*keys, "_i").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        bounds = ranges.groupBy(*keys).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_i", "lo", "hi"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("_bounds"))
        scaled = settle(_scale_elements(train, bounds, lay, features), lay, "sequences")
        space = fit_subspace(scaled, lay, latent_dim, features, rows=SequenceRows(seq_len), chunk_rows=max(SEQUENCE_CHUNK, seq_len))
        return cut_lineage(space.join(bounds, keys), "sequence-ae")

    def compute(rows: pd.DataFrame, params: pd.DataFrame) -> dict:
        p = params.iloc[0]
        axes, mean = np.asarray(p["components"], dtype=float).reshape(int(p["k"]), -1), np.asarray(p["mean"], dtype=float)
        order = np.argsort(rows["pos"].to_numpy())
        x = matrix_of(rows[features])[order]
        errors = np.full(len(x), np.nan)
        for start in range(0, len(x) - seq_len + 1, 512):
            flat = np.lib.stride_tricks.sliding_window_view(x[start:start + 511 + seq_len], seq_len, axis=0)
            flat = flat.transpose(0, 2, 1).reshape(len(flat), -1) - mean
            rest = flat - (flat @ axes.T) @ axes
            errors[start + seq_len - 1:start + seq_len - 1 + len(flat)] = (rest * rest).mean(axis=1)
        out = np.empty(len(x))
        out[order] = errors
        return {"error": out}

    def score(rows: DataFrame, params: DataFrame, lay: Layout) -> DataFrame:
        shared = [k for k in lay.keys if k in params.columns]
        scaled = settle(_scale_elements(rows, params.select(*shared, "_bounds"), lay, features), lay, "sequences")
        errors = per_halo_chunk(scaled.select(*lay.keys, "pos", features), params.drop("_bounds"), lay.keys, compute, {"error": "double"},
                                before=seq_len - 1, drop=(features,), chunk_rows=max(SEQUENCE_CHUNK, seq_len))
        errors = cut_lineage(errors, "sequence-errors")
        joined = rows.drop(features).join(errors, [*lay.keys, "pos"], "left")
        full = with_totals(joined, lay, {"_least": F.min("error")})
        return full.withColumn("score", F.coalesce("error", "_least")).drop("error", "_least")

    return Detector("Sequence autoencoder", "sequence_ae", fit, score)


register_detector("hotelling_t2", hotelling_t2)
register_detector("sequence_ae", sequence_ae)
