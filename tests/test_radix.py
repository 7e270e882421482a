"""Radix selection of percentiles over many columns."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.detectors import chunks
from alarmspan.layout import Layout
from alarmspan.operators import quantile, scale

LAY = Layout(max_rows=1000)


def test_order_of_doubles_is_the_order_of_their_keys():
    x = np.array([-np.inf, -1e300, -1.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, np.inf])
    keys = quantile.sortable(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5]
    assert np.array_equal(quantile.unsorted(keys), x)


@pytest.mark.parametrize("ship", [chunks.SHIP_BYTES, -1])
def test_percentiles_are_exact(spark, monkeypatch, ship):
    monkeypatch.setattr(chunks.emitted_by_series, "__defaults__", (None, 20, ship))
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=(101, 4)) * [1, 1e-200, 1e9, 1], "b": rng.normal(size=(40, 4)), "c": rng.normal(size=(1, 4))}
    series["a"][:, 3] = np.repeat([1.0, 2.0, -0.0], [60, 40, 1])       # ties
    series["b"][::3, 1] = np.nan
    series["b"][:2, 2] = [np.inf, -np.inf]
    rows = [(k, *[None if np.isnan(v) and i % 2 else float(v) for v in r]) for k, x in series.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, c0 double, c1 double, c2 double, c3 double")
    ranks = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["series_id"], r["column"]): r["quantiles"] for r in quantile.column_quantiles(df, LAY, ["c0", "c1", "c2", "c3"], ranks).collect()}
    assert len(got) == 12
    for (k, c), q in got.items():
        v = series[k][:, c]
        finite = v[~np.isnan(v)]
        assert (q[0], q[-1]) == (finite.min(), finite.max())
        assert np.allclose(q[1:-1], np.quantile(finite, ranks[1:-1]), rtol=1e-15, atol=0), (k, c)


def test_wide_scaler_equals_the_narrow_one(spark):
    rng = np.random.default_rng(2)
    names = [f"c{i}" for i in range(70)]
    rows = [("a" if i % 3 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), *map(float, r)) for i, r in enumerate(rng.normal(size=(60, 70)))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, " + ", ".join(f"{c} double" for c in names)).withColumn("c5", F.lit(2.0))
    wide = {r["series_id"]: r.asDict() for r in scale.fit_scaler(df, LAY, names).collect()}
    narrow = {r["series_id"]: r.asDict() for r in scale.fit_scaler(df, LAY, names[:8]).collect()}
    for k, row in narrow.items():
        assert all(np.isclose(wide[k][c], x) for c, x in row.items() if c != "series_id")
    assert wide["a"]["c5__scale"] == 1.0 and len(wide["a"]) == 141
