"""Windows merged from panes against every window worked out from its own rows."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators import features
from alarmspan.operators.ordered import with_position

T0 = dt.datetime(2024, 1, 1)
LAYOUTS = [Layout(max_rows=1000), Layout(block_rows=25)]


def frame(spark, x, lay, names):
    rows = [("a", T0 + dt.timedelta(minutes=i), *[None if v is None else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, " + ", ".join(f"{c} double" for c in names))
    return with_position(df, lay)


def expected(x, features_, names):
    """Statistics of one window, straight from its values."""
    out = {}
    for c, v in zip(names, np.array(x, dtype=object).T):
        v = np.array([u for u in v if u is not None], dtype=float)
        sd, mu = v.std(), v.mean()
        z = (v - mu) / (sd + 1e-12)
        rms = np.sqrt((v * v).mean())
        all_ = {"rms": rms, "kurtosis": (z ** 4).mean() - 3, "skewness": (z ** 3).mean(), "variance": v.var(), "mean_abs": np.abs(v).mean(),
                "peak_to_peak": v.max() - v.min(), "crest_factor": np.abs(v).max() / (rms + 1e-12),
                "shape_factor": (rms + 1e-12) / (np.abs(v).mean() + 1e-12)}
        out |= {features.feature_name(features.PREFIX[f], c): all_[f] for f in features_}
    return out


@pytest.mark.parametrize("lay", LAYOUTS)
@pytest.mark.parametrize("window, overlap", [(10, 0.5), (10, 0.3), (12, 0.75), (7, 0.0), (9, 0.9)])
def test_windows_equal_their_rows(spark, lay, window, overlap):
    rng = np.random.default_rng(window)
    x = rng.normal(size=(61, 2)).astype(object)
    x[20:32, 1] = 4.0           # constant windows
    x[45, 0] = None
    got = features.rolling_features(frame(spark, x, lay, "uv"), lay, ["u", "v"], window, overlap, tuple(features.PREFIX)).collect()
    step = features.window_step(window, overlap)
    assert sorted(r["w"] for r in got) == list(range((61 - window) // step + 1))
    for r in got:
        rows = x[r["w"] * step:r["w"] * step + window]
        assert r["ts"] == T0 + dt.timedelta(minutes=r["w"] * step + window // 2)
        for name, value in expected(rows, features.PREFIX, "uv").items():
            assert math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-9), (name, r["w"])
        gap = any(v is None for v in rows[:, 0])
        pair = 0.0 if gap or np.std(rows[:, 1].astype(float)) == 0 else np.corrcoef(rows.astype(float).T)[0, 1]
        assert math.isclose(r["corr_u_v"], pair, abs_tol=1e-9)


def test_an_offset_costs_no_digits(spark):
    x = np.random.default_rng(1).normal(size=(80, 2))
    lay = LAYOUTS[0]
    plain = features.rolling_features(frame(spark, x, lay, "uv"), lay, ["u", "v"], 20, 0.5, ("kurtosis", "skewness", "variance")).orderBy("w").collect()
    far = features.rolling_features(frame(spark, x + 1e9, lay, "uv"), lay, ["u", "v"], 20, 0.5, ("kurtosis", "skewness", "variance")).orderBy("w").collect()
    for a, b in zip(plain, far):
        assert all(math.isclose(a[c], b[c], rel_tol=1e-5, abs_tol=1e-5) for c in a.asDict() if c not in ("ts", "w", "series_id"))


@pytest.mark.parametrize("n", [12, 14])
def test_correlations_do_not_depend_on_how_many_channels_there_are(spark, n):
    """Few channels are expressions, many are products; a window with a value that is not finite has correlation 0 in both."""
    names = [f"c{i}" for i in range(n)]
    x = np.random.default_rng(2).normal(size=(200, n)).astype(object)
    x[7, 1], x[57, 1], x[107, 1] = float("inf"), float("nan"), None
    lay = LAYOUTS[0]
    got = features.rolling_features(frame(spark, x, lay, names), lay, names, 10, 0.3, ("rms",)).collect()
    assert len(got) == (200 - 10) // 7 + 1
    for r in got:
        rows = x[r["w"] * 7:r["w"] * 7 + 10]
        broken = any(v is None or not np.isfinite(v) for v in rows[:, 1])
        other = np.corrcoef(rows[:, [0, 2]].astype(float).T)[0, 1]
        assert math.isclose(r["corr_c0_c2"], other, abs_tol=1e-9)
        assert r["corr_c0_c1"] == 0.0 if broken else math.isclose(r["corr_c0_c1"], np.corrcoef(rows[:, [0, 1]].astype(float).T)[0, 1], abs_tol=1e-9)


def test_rows_are_not_handed_to_windows(spark):
    lay = LAYOUTS[0]
    x = np.random.default_rng(3).normal(size=(100, 2))
    out = features.rolling_features(frame(spark, x, lay, "uv"), lay, ["u", "v"], 10, 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert plan.count("Generate") == 1 and "Aggregate" in below  # what is exploded has been aggregated


def test_a_feature_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(features, "PREFIX", dict(features.PREFIX))
    monkeypatch.setattr(features, "BUILDERS", dict(features.BUILDERS))
    features.register_feature("median", "med", F.median)
    x = np.random.default_rng(4).normal(size=(40, 1))
    for lay in LAYOUTS:
        got = features.rolling_features(frame(spark, x, lay, "u"), lay, ["u"], 10, 0.3, ("rms", "median", "variance")).collect()
        assert [c for c in got[0].asDict() if c.endswith("_u")] == ["rms_u", "med_u", "var_u"]
        for r in got:
            assert math.isclose(r["med_u"], np.median(x[r["w"] * 7:r["w"] * 7 + 10]))


def test_common_divisor(spark):
    pairs = [(10, 5), (9, 6), (7, 3), (1134903170, 701408733), (4, 4)]
    got = spark.createDataFrame(pairs, "a long, b long").select(features.common_divisor(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [math.gcd(*p) for p in pairs]
