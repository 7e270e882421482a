"""Trailing aggregates in two pieces and lags by convolution, against each frame and each lag worked out alone."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators import clean, correlation, health, ordered
from alarmspan.operators.ordered import with_position

T0 = dt.datetime(2024, 1, 1)
LAYOUTS = [Layout(max_rows=1000), Layout(block_rows=25)]


def frame(spark, lay, **cols):
    n = len(next(iter(cols.values())))
    value = lambda v: None if v is None else float(v)
    rows = [("a", T0 + dt.timedelta(minutes=i), *[value(c[i]) for c in cols.values()]) for i in range(n)]
    return with_position(spark.createDataFrame(rows, "series_id string, ts timestamp, " + ", ".join(f"{c} double" for c in cols)), lay)


@pytest.mark.parametrize("lay", LAYOUTS)
@pytest.mark.parametrize("window", [1, 2, 7, 30, 500])
@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_trailing_pieces_equal_the_frame(spark, lay, window, offset):
    rng = np.random.default_rng(window)
    a, b = rng.normal(size=(2, 120)) + offset
    b = a * 0.5 + b
    a[40:60] = offset + 2.0
    with_gap = [None if i % 11 == 3 else v for i, v in enumerate(a)]
    df = frame(spark, lay, a=a, b=b, gap=with_gap)
    means = ordered.trailing_mean(df, lay, F.col("gap"), window, "mean")
    got = ordered.trailing_moments(means, lay, window, {"x": F.col("a"), "y": F.col("b")}, [("x", "y")]).orderBy("pos").collect()
    for i, r in enumerate(got):
        rows = slice(max(0, i - window + 1), i + 1)
        present = [v for v in with_gap[rows] if v is not None]
        assert r["mean"] is None if not present else math.isclose(r["mean"], np.mean(present), rel_tol=1e-12)
        assert r["_count_x"] == len(a[rows])
        assert math.isclose(r["_var_x"], a[rows].var(), rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(r["_cov_x_y"], np.cov(a[rows], b[rows], bias=True)[0, 1], rel_tol=1e-5, abs_tol=1e-6 if offset else 1e-9)
        if window == 7 and 46 <= i < 60:
            assert r["_var_x"] == 0.0


def test_no_frame_grows_with_the_window(spark):
    lay = LAYOUTS[0]
    df = frame(spark, lay, a=np.arange(50.0), b=np.arange(50.0) ** 2)
    for out in (health.rolling_trend(df, lay, "a", 2160), clean.stuck_mask(df, lay, ["a"], 2160)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "-2159" in plan and "RowFrame, -2159, currentrow" not in plan.replace("$", "").lower()
        assert "rowframe, -2159, 0" not in plan.lower()


def pairs(spark, a, b):
    rows = [("s", "p", "q", T0 + dt.timedelta(minutes=i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "series_id string, chan_a string, chan_b string, ts timestamp, a double, b double")


@pytest.mark.parametrize("lay", LAYOUTS)
@pytest.mark.parametrize("chunk", [16, 8192])
@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_lags_equal_each_lag_alone(spark, lay, chunk, offset):
    rng = np.random.default_rng(chunk)
    b = np.cumsum(rng.normal(size=150))
    a = np.roll(b, 4) + rng.normal(size=150) * 0.1
    got = {r["lag"]: r for r in correlation.lagged_correlation(pairs(spark, a + offset, b + offset), correlation.pair_layout(lay), 12, chunk).collect()}
    assert sorted(got) == list(range(-12, 13))
    for k, r in got.items():
        x, y = (a[k:], b[:len(b) - k]) if k >= 0 else (a[:k], b[-k:])
        assert math.isclose(r["r"], np.corrcoef(x, y)[0, 1], abs_tol=1e-5 if offset else 1e-9)
        assert r["n"] == 150 and math.isclose(r["bound"], 1.96 / math.sqrt(150))
    assert max(got, key=lambda k: abs(got[k]["r"])) == 4


def test_lags_of_short_and_constant_pairs(spark):
    lay = correlation.pair_layout(LAYOUTS[0])
    flat = correlation.lagged_correlation(pairs(spark, [0.1 + 0.2] * 30, range(30)), lay, 5, 8).collect()
    assert len(flat) == 11 and all(r["r"] == 0.0 for r in flat)
    short = {r["lag"]: r["r"] for r in correlation.lagged_correlation(pairs(spark, [1, 2, 4], [2, 3, 9]), lay, 5).collect()}
    assert short[5] == short[-5] == 0.0 and math.isclose(short[0], np.corrcoef([1, 2, 4], [2, 3, 9])[0, 1])
