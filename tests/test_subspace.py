"""Range-finding subspaces against full decompositions."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.detectors import chunks, pca
from alarmspan.layout import Layout

T0 = dt.datetime(2024, 1, 1)
LAY = Layout(max_rows=10_000)


def frame(spark, series):
    rows = [(s, T0 + dt.timedelta(minutes=i), i, [float(v) for v in r]) for s, x in series.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, pos bigint, features array<double>")


def leading(x, k):
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    return mean, values[::-1][:k], vectors[:, ::-1][:, :k]


def same_space(row, x, k):
    mean, values, vectors = leading(x, k)
    axes = np.array(row["components"]).reshape(row["k"], -1)
    assert row["k"] == k and row["n_train"] == len(x)
    assert np.allclose(row["mean"], mean)
    assert np.allclose(np.array(row["spread"]) ** 2, values, rtol=1e-6)
    assert np.allclose(axes @ axes.T, np.eye(k), atol=1e-9)
    # The same subspace: every true direction lies in the one found.
    assert np.allclose(np.linalg.norm(vectors.T @ axes.T, axis=1), 1, atol=1e-6)


@pytest.mark.parametrize("ship", [chunks.SHIP_BYTES, -1])
def test_agrees_with_the_full_decomposition(spark, monkeypatch, ship):
    monkeypatch.setattr(chunks.summed_by_series, "__defaults__", (None, 0, 50, ship))
    rng = np.random.default_rng(1)
    decay = 0.8 ** np.arange(40)
    series = {s: rng.normal(size=(200, 40)) * decay @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 1e6 for s in "ab"}
    got = pca.fit_subspace(frame(spark, series), LAY, 5, extra=10, tolerance=1e-9, chunk_rows=50).collect()
    assert {r["series_id"] for r in got} == {"a", "b"}
    for r in got:
        assert r["residual"] <= 1e-9
        same_space(r, series[r["series_id"]], 5)


def test_wide_rows_need_no_square_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 12)) * 0.7 ** np.arange(12) @ rng.normal(size=(12, 1465)) + 1e-3 * rng.normal(size=(120, 1465))
    row = pca.fit_subspace(frame(spark, {"a": x}), LAY, 10, extra=10).first()
    assert row["residual"] <= 1e-7
    mean, values, vectors = leading(x, 10)
    assert np.allclose(np.array(row["spread"]) ** 2, values, rtol=1e-6)


def test_scores_of_training_rows_add_up(spark):
    """In-sample squared distances in k directions, each in its own deviations, sum to n k."""
    x = np.random.default_rng(3).normal(size=(90, 80)) * np.linspace(3, 0.1, 80)
    df = frame(spark, {"a": x})
    det = pca.hotelling_t2()
    total = det.score(df, det.fit(df, LAY), LAY).agg(F.sum("score")).first()[0]
    assert np.isclose(total, 90 * 10, rtol=1e-6)


@pytest.mark.parametrize("chunk", [64, 4096])
def test_sequences_are_never_flattened_but_equal_it(spark, monkeypatch, chunk):
    monkeypatch.setattr(pca, "SEQUENCE_CHUNK", chunk)
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(150, 6)), axis=0)
    df = frame(spark, {"a": x, "short": x[:20]})
    det = pca.sequence_ae(seq_len=30, latent_dim=4)
    params = det.fit(df, LAY)
    got = {(r["series_id"], r["pos"]): r["score"] for r in det.score(df, params, LAY).collect()}
    unit = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    flat = np.stack([unit[i:i + 30].ravel() for i in range(121)])
    same_space(params.where("series_id = 'a'").first(), flat, 4)
    mean, _, axes = leading(flat, 4)
    rest = (flat - mean) - (flat - mean) @ axes @ axes.T
    errors = (rest ** 2).mean(axis=1)
    assert np.allclose([got["a", i + 29] for i in range(121)], errors, rtol=1e-6, atol=1e-12)
    assert np.allclose([got["a", i] for i in range(29)], errors.min(), rtol=1e-6)
    assert params.where("series_id = 'short'").count() == 0
