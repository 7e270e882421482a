"""Hand-computed rows for each operator family, in the whole and the block plan."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alarmspan.functions import tails, timeparse
from alarmspan.layout import Layout
from alarmspan.operators import alarms, asof, clean, correlation, features, metrics, resample, scale, split, thresholds, uncertainty
from alarmspan.operators.ordered import with_position

LAYOUTS = [Layout(max_rows=500), Layout(block_rows=3)]
T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, col="v", step_s=3600, series="a"):
    rows = [(series, T0 + dt.timedelta(seconds=step_s * i), i, len(values), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, ts timestamp, pos bigint, n bigint, {col} double")


def column(df, name, order="pos"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


@pytest.mark.parametrize("lay", LAYOUTS)
def test_persistence(spark, lay):
    hits = [0, 1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1]
    df = frame(spark, hits)
    keep = lambda p: [int(x) for x in column(alarms.persistence_filter(df, lay, F.col("v") > 0.5, p), "alarm")]
    assert keep(3) == [0, 0, 0, 0, 1, 1, 1, 1, 0, 1, 1, 1]
    assert keep(1) == keep(0) == hits
    assert keep(13) == [0] * 12
    by_score = [int(x) for x in column(alarms.alarm_signal(df, lay, F.lit(0.5), 3, score="v"), "alarm")]
    assert by_score == keep(3)


@pytest.mark.parametrize("lay", LAYOUTS)
def test_episodes_and_first_sustained(spark, lay):
    df = frame(spark, [0, 1, 1, 0, 0, 1, 1, 1]).withColumn("alarm", F.col("v") > 0)
    got = {(r.start_ts.hour, r.end_ts.hour, r.steps, r.open_end) for r in alarms.alarm_episodes(df, lay).collect()}
    assert got == {(1, 3, 2, False), (5, 7, 3, True)}
    assert alarms.first_sustained(df, lay, F.col("alarm"), 3).first().first_alarm.hour == 5
    assert alarms.first_sustained(df, lay, F.col("alarm"), 4).first().first_alarm is None


def test_nan_scores_never_hit(spark):
    df = frame(spark, [1, float("nan"), 1])
    from alarmspan.functions.stats import finite
    assert [r[0] for r in df.orderBy("pos").select(finite(F.col("v"))).collect()] == [1.0, None, 1.0]


@pytest.mark.parametrize("lay", LAYOUTS)
def test_gap_fill(spark, lay):
    ten = clean.fill_missing(frame(spark, [1] + [None] * 10 + [2]), lay, ["v"], "ffill", 5)
    assert column(ten, "v") == [1.0] * 6 + [2.0] * 6
    assert clean.fill_missing(frame(spark, [1] + [None] * 12 + [2]), lay, ["v"], "ffill", 5).count() == 12
    lin = clean.fill_missing(frame(spark, [None, 0, None, None, 3, None]), lay, ["v"], "interpolate", 1)
    assert column(lin, "v") == [0.0, 1.0, 3.0, 3.0] and column(lin, "pos") == [1, 2, 4, 5]
    assert column(clean.fill_missing(frame(spark, [None, 1, None]), lay, ["v"], "other"), "v") == [1.0]
    assert column(clean.fill_unlimited(frame(spark, [None, 1, None, 2, None]), lay, ["v"]), "v") == [1, 1, 1, 2, 2]


@pytest.mark.parametrize("lay", LAYOUTS)
def test_stuck_and_spikes(spark, lay):
    df = frame(spark, [1, 1, 1, 1, 2, 2, 2])
    assert column(clean.stuck_mask(df, lay, ["v"], 3), "stuck_v") == [False, False, True, True, False, False, True]
    x = [0.0] * 20 + [100.0]
    mu, sd = np.mean(x), np.std(x, ddof=1)
    assert column(clean.clip_spikes(frame(spark, x), lay, ["v"], 2.0), "v")[-1] == pytest.approx(mu + 2 * sd)


def test_timestamps_from_names_and_logs(spark):
    names = [("2004.02.12.10.32.39", 0), ("1066829999", 1), ("snapshot", 7)]
    df = spark.createDataFrame(names, "name string, rank int")
    got = [r[0] for r in df.select(timeparse.timestamp_from_name(F.col("name"), F.col("rank"))).collect()]
    assert got == [dt.datetime(2004, 2, 12, 10, 32), dt.datetime(2003, 10, 22, 13, 39, 59), dt.datetime(2003, 10, 22, 0, 7)]
    kept = df.select(timeparse.timestamp_from_name(F.col("name"), F.col("rank"), True)).first()[0]
    assert kept == dt.datetime(2004, 2, 12, 10, 32, 39)
    logs = spark.createDataFrame([("13-11-2023# 09:46:00",), ("2023-11-13 09:46",), ("13/11/2023 09:46:01",), ("n/a",)], "s string")
    out = [r[0] for r in logs.select(timeparse.parse_log_timestamp(F.col("s"))).collect()]
    assert out == [dt.datetime(2023, 11, 13, 9, 46), dt.datetime(2023, 11, 13, 9, 46), dt.datetime(2023, 11, 13, 9, 46, 1), None]
    assert timeparse.feature_name("rms", "rms_ch0") == "rms_rmsch0" and timeparse.pair_name("a_1", "b_2") == "corr_a1_b2"


def test_derived_counts(spark):
    df = spark.createDataFrame([(f,) for f in (1, 2, 5, 10, 20)], "factor bigint")
    out = resample.derive_counts(df, F.lit(10.0), F.col("factor"), F.lit(100.0), F.lit(150.0))
    got = [tuple(r) for r in out.orderBy("factor").select("effective_min", "window_rows", "stride_rows", "persistence_windows", "window_floored").collect()]
    assert got == [(10, 10, 5, 3, False), (20, 5, 2, 4, False), (50, 3, 2, 2, True), (100, 3, 2, 1, True), (200, 3, 2, 1, True)]


def test_resample_matches_pandas_bins(spark):
    rows = [("a", T0 + dt.timedelta(minutes=33 * i + 11), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, v double")
    pdf = pd.DataFrame(rows, columns=["s", "ts", "v"]).set_index("ts")[["v"]]
    for minutes in (20, 50, 100, 200):
        want = pdf.resample(f"{minutes}min").mean().dropna(how="all")
        got = resample.resample_mean(df, LAYOUTS[0], ["v"], minutes).orderBy("ts").toPandas()
        assert list(got.ts) == list(want.index) and np.allclose(got.v, want.v)


@pytest.mark.parametrize("lay", LAYOUTS)
def test_windows(spark, lay):
    rows = features.rolling_features(frame(spark, [1, 2, 3, 4, 10]), lay, ["v"], 5, 0.5, (*features.ALL_FEATURES, "mean_abs")).first()
    assert rows.rms_v == pytest.approx(5.0990195136) and rows.kurt_v == pytest.approx(-0.212)
    assert rows.skew_v == pytest.approx(1.1384199577) and rows.crest_v == pytest.approx(1.9611613514)
    assert rows.shape_v == pytest.approx(1.2747548784) and rows.var_v == pytest.approx(10) and rows.p2p_v == 9
    flat = features.rolling_features(frame(spark, [2] * 5), lay, ["v"], 5, 0.5).first()
    assert flat.kurt_v == -3.0 and flat.skew_v == 0.0
    snap = features.snapshot_statistics(frame(spark, [2] * 5), ["series_id"], F.col("v")).first()
    assert snap.kurt == 0.0 and snap.skew == 0.0
    assert features.rolling_features(frame(spark, [1, 2]), lay, ["v"], 5).count() == 0


def test_window_counts_and_feature_names(spark):
    for n, want in ((25618, 283), (17080, 188)):
        df = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("n"))
        assert features.to_windows(df, 180, 90).select("w").distinct().count() == want
    eight = [f"{s}_ch{k}" for s in ("rms", "kurt", "skew", "p2p", "crest", "var") for k in range(8)]
    assert len(features.feature_columns(eight)) == 1465
    assert len(features.feature_columns([c for c in eight if c[-1] in "0123"])) == 445


def test_many_channels_take_the_matrix_path(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(24, 14))
    x[:, 13] = 5.0
    cols = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), i, 24, *map(float, r)) for i, r in enumerate(x)],
                               "series_id string, ts timestamp, pos bigint, n bigint, " + ", ".join(f"{c} double" for c in cols))
    row = features.rolling_features(df, LAYOUTS[0], cols, 12, 0.5, ("rms",)).where("w = 1").first()
    want = np.corrcoef(x[6:18, :13].T)
    assert row["corr_c2_c7"] == pytest.approx(want[2, 7]) and row["corr_c2_c13"] == 0.0
    assert row["cov_trace"] == pytest.approx(x[6:18].var(axis=0, ddof=1).sum())


def test_split(spark):
    for n, want in ((7, (3, 1, 3)), (8, (4, 0, 4))):
        out = split.temporal_split(frame(spark, range(n)), 0.5, 0.1).groupBy("split").count().collect()
        got = {r[0]: r[1] for r in out}
        assert tuple(got.get(k, 0) for k in ("train", "cal", "test")) == want


@pytest.mark.parametrize("lay", LAYOUTS)
def test_thresholds(spark, lay):
    scores = [i / 10 for i in range(1, 11)]
    df = frame(spark, scores, "score")
    assert thresholds.compute_threshold(df, lay).first().threshold == pytest.approx(0.9775)
    assert thresholds.compute_threshold(df, lay, accuracy=1000).first().threshold == 1.0
    assert thresholds.compute_threshold(df, lay, "ewma").first().threshold == pytest.approx(0.5122603304)
    assert thresholds.compute_threshold(df, lay, "evt").first().threshold == pytest.approx(np.percentile(scores, 99))
    with pytest.raises(ValueError):
        thresholds.compute_threshold(df, lay, "other")


@pytest.mark.parametrize("lay", LAYOUTS)
def test_dynamic_threshold(spark, lay):
    rng = np.random.default_rng(3)
    s = rng.normal(size=20)
    mean, var = s[:5].mean(), (s[:5].std() + 1e-12) ** 2
    want = [mean + 3 * (math.sqrt(var) + 1e-12) * math.sqrt(.2 / 1.8)]
    for x in s[1:]:
        mean = .2 * x + .8 * mean
        var = .2 * (x - mean) ** 2 + .8 * var
        want.append(mean + 3 * (math.sqrt(var) + 1e-12) * math.sqrt(.2 / 1.8))
    got = column(thresholds.dynamic_threshold(frame(spark, s, "score"), lay, warmup=5), "threshold")
    assert np.allclose(got, want)


def test_evt_maximises_the_likelihood(spark):
    rng = np.random.default_rng(11)
    for shape in (0.3, -0.2):
        x = (rng.uniform(size=4000) ** -shape - 1) / shape
        row = thresholds.compute_threshold(frame(spark, x, "score"), Layout(max_rows=5000), "evt").first()
        u = np.percentile(x, 95)
        tail = x[x > u] - u
        def loglik(xi, sigma):
            z = 1 + xi * tail / sigma
            return -np.inf if sigma <= 0 or (z <= 0).any() else -len(tail) * np.log(sigma) - (1 / xi + 1) * np.log(z).sum()
        ours = loglik(row["shape"], row["scale"])
        best = max(loglik(row["shape"] + a, row["scale"] * b) for a in np.linspace(-.1, .1, 21) for b in np.linspace(.8, 1.2, 21))
        assert best - ours < 0.02
        assert row.threshold == pytest.approx(u + row["scale"] / row["shape"] * (0.01 ** -row["shape"] - 1))


def test_lead_metrics(spark):
    h = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)
    rows = [(None, 0.0), (h(12), 0.0), (h(13), 0.0), (h(4), 0.0), (h(4.5), 7.5)]
    df = spark.createDataFrame([(f, w) for f, w in rows], "fat timestamp, want double")
    out = df.select(metrics.valid_lead_hours(F.col("fat"), F.lit(h(12)), F.lit(h(4))).alias("g"), "want").collect()
    assert all(r.g == r.want for r in out)
    ten = frame(spark, [0, 1, 0, 0, 0, 0, 0, 0, 0, 0])
    far = ten.agg(metrics.false_alarm_rate(F.col("v") > 0, F.col("ts"), F.lit(h(2)))).first()[0]
    assert far == pytest.approx(1 / 3)
    none = ten.where("v > 5").agg(metrics.false_alarm_rate(F.col("v") > 0, F.col("ts"), F.lit(h(2))), metrics.miss_rate(F.col("v") > 0)).first()
    assert tuple(none) == (0.0, 1.0)
    delay = df.select(metrics.detection_delay_hours(F.col("fat"), F.lit(h(12)))).collect()
    assert [r[0] for r in delay] == [None, 0.0, 1.0, None, None]


@pytest.mark.parametrize("lay", [Layout(max_rows=50), Layout(block_rows=2)])
def test_conformal(spark, lay):
    rows = [("a", T0 + dt.timedelta(hours=i), s, k, float(x)) for i, (s, k, x) in enumerate(
        [("cal", 0, 1), ("cal", 1, 2), ("cal", 2, 3), ("cal", 3, 4), ("test", 0, 0), ("test", 1, 2.5), ("test", 2, 4), ("test", 3, 5)])]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, split string, split_pos bigint, score double")
    out = uncertainty.conformal_pvalues(df, lay)
    assert np.allclose(column(out, "p_value", "split_pos"), [.8, .4, .2, 0])
    alarmed = uncertainty.conformal_alarm(out, lay, 0.25, 2)
    assert column(alarmed, "alarm", "split_pos") == [False, False, True, True]


@pytest.mark.parametrize("lay", LAYOUTS)
def test_lag_sign(spark, lay):
    a = [1, 2, 3, 4, 7, 11, 18, 29]
    b = [0] + a[:-1]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "series_id string, ts timestamp, a double, b double")
    pairs = correlation.channel_pairs(df, lay, ["a", "b"])
    table = correlation.lagged_correlation(pairs, correlation.pair_layout(lay), 1)
    r = {x.lag: x.r for x in table.collect()}
    assert r[-1] == pytest.approx(1.0) and r[0] == pytest.approx(.9983465856) and r[1] == pytest.approx(.9944577059)
    best = correlation.lead_lag(table, correlation.pair_layout(lay)).first()
    assert best.best_lag == -1 and best.leader == "a"
    roll = correlation.rolling_correlation(pairs, correlation.pair_layout(lay), 4)
    want = pd.Series(a, dtype=float).rolling(4, min_periods=1).corr(pd.Series(b, dtype=float)).to_numpy()
    got = np.array([np.nan if x is None else x for x in column(roll, "rolling_r")])
    assert np.allclose(got[1:], want[1:], equal_nan=True)


def test_tails():
    assert tails.chi2_quantile(0.99, 10) == pytest.approx(23.209251, abs=1e-5)
    assert tails.chi2_quantile(0.99, 1) == pytest.approx(6.634897, abs=1e-5)
    assert tails._student_two_sided(0.5, 12) == pytest.approx(0.0978, abs=5e-4)
    assert tails._student_two_sided(0.0, 30) == pytest.approx(1.0, abs=1e-9)
    assert tails._student_two_sided(0.9, 3) == pytest.approx(2 / math.pi * math.acos(0.9), abs=1e-9)


@pytest.mark.parametrize("lay", LAYOUTS)
def test_asof_prefers_the_later_row_on_a_tie(spark, lay):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(30), 2), ("a", at(90), 3)], "series_id string, ts timestamp, k int")
    right = spark.createDataFrame([("a", at(8), "x"), ("a", at(12), "y"), ("a", at(30), "z")], "series_id string, ts timestamp, tag string")
    near = {r.k: r.tag for r in asof.asof_nearest(left, right, lay, ["tag"]).collect()}
    assert near == {1: "y", 2: "z", 3: "z"}
    close = {r.k: r.tag for r in asof.asof_nearest(left, right, lay, ["tag"], 300).collect()}
    assert close == {1: "y", 2: "z", 3: None}


@pytest.mark.parametrize("lay", LAYOUTS)
def test_scalers(spark, lay):
    x = [1, 2, 3, 4, 10]
    df = frame(spark, x)
    got = {k: column(scale.apply_scaler(df, scale.fit_scaler(df, lay, ["v"], k), lay, ["v"]), "v") for k in scale.KINDS}
    assert np.allclose(got["robust"], (np.array(x) - 3) / 2)
    assert np.allclose(got["standard"], (np.array(x) - 4) / np.std(x))
    assert np.allclose(got["minmax"], (np.array(x) - 1) / 9)
    flat = frame(spark, [5, 5, 5])
    assert all(column(scale.apply_scaler(flat, scale.fit_scaler(flat, lay, ["v"], k), lay, ["v"]), "v") == [0, 0, 0] for k in scale.KINDS)
    with pytest.raises(ValueError):
        scale.fit_scaler(df, lay, ["v"], "other")
    soft = column(scale.minmax_normalise(df, lay, "v", "o", softened=True), "o")
    assert np.allclose(soft, (np.array(x) - 1) / 9)
