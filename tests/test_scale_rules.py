"""Rules that keep results equal at every size, and hot series spread over tasks."""
from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators.alarms import alarm_episodes, alarm_signal
from alarmspan.operators.features import rolling_features
from alarmspan.operators.ordered import with_position
from alarmspan.operators.quantile import quantile_table
from alarmspan.operators.thresholds import dynamic_threshold, evt_threshold
from alarmspan.operators.uncertainty import weighted_moments_interval
from alarmspan.session import clear_scratch, cut_lineage, shared_folder

BLOCKS, WHOLE = Layout(block_rows=500, cell_us=3_600_000_000), Layout(max_rows=10_000)


def series(spark, values, **more):
    rows = [(1, i, float(v), *(float(c[i]) if c[i] is not None else None for c in more.values())) for i, v in enumerate(values)]
    names = "".join(f", {k} double" for k in more)
    df = spark.createDataFrame(rows, f"series_id long, pos long, score double{names}")
    return df.withColumns({"ts": F.timestamp_seconds(F.col("pos") * 60), "n": F.lit(len(rows)).cast("long")})


def windows_over_series_joins(df) -> list[str]:
    """Windows on blocks that stand over a join by series alone with no exchange between."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+\-*()\d]*", line)[0])
    bad = []
    for i, line in enumerate(lines):
        if " Window " not in line and not line.lstrip(" :+-*(0123456789)").startswith("Window") or "_block" not in line:
            continue
        for below in lines[i + 1:]:
            if depth(below) <= depth(line) or "Exchange" in below:
                break
            if re.search(r"(SortMergeJoin|ShuffledHashJoin) \[series_id#\w+\],", below):
                bad.append(line.strip()[:80])
                break
    return bad


@pytest.mark.parametrize("build", [
    lambda df: alarm_signal(df, BLOCKS, F.lit(0.5)),
    lambda df: alarm_episodes(df.withColumn("alarm", F.col("score") > 0.5), BLOCKS),
    lambda df: dynamic_threshold(df, BLOCKS)], ids=["persistence", "episodes", "dynamic"])
def test_hot_series_is_not_gathered_by_series(spark, build):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert windows_over_series_joins(build(series(spark, np.random.default_rng(0).random(3000)))) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("shape", [1.5, 0.3, -0.2])
def test_tail_fit_is_the_likelihood_maximum(spark, shape):
    u = np.random.default_rng(3).random(4000)
    x = ((1 - u) ** -shape - 1) / shape
    got = evt_threshold(series(spark, x), WHOLE).first()
    q = np.quantile(x, 0.95)
    t = x[x > q] - q
    grid = np.concatenate([-1 / t.max() * np.linspace(0.999, 0.001, 3000), np.logspace(-5, 5, 30_000) / t.mean()])
    xi = np.array([np.log1p(g * t).mean() for g in grid])
    with np.errstate(invalid="ignore"):
        best = np.nanargmax(np.where(xi > -1, -np.log(xi / grid) - xi, -np.inf))
    want = q + (0.01 ** -xi[best] - 1) / grid[best]
    assert got["shape"] == pytest.approx(xi[best], rel=2e-3, abs=2e-3)
    assert got["threshold"] == pytest.approx(want, rel=2e-3)
    assert evt_threshold(series(spark, x), BLOCKS).first()["threshold"] == pytest.approx(got["threshold"], rel=1e-9)


@pytest.mark.parametrize("channels", [3, 14])
def test_correlations_with_gaps_are_zero_at_any_width(spark, channels):
    rng = np.random.default_rng(channels)
    cols = {f"c{i}": list(rng.normal(size=40)) for i in range(channels)}
    cols["c0"][3] = None
    out = rolling_features(series(spark, np.zeros(40), **cols), WHOLE, list(cols), 20, 0.0, ("rms",)).orderBy("w").collect()
    names = [c for c in out[0].asDict() if "c0" in c and "c1" in c and not c.endswith(("c10", "c11", "c12", "c13"))]
    assert names and out[0][names[0]] == 0.0 and abs(out[1][names[0]]) > 0


def test_percentiles_with_infinities_agree_in_both_plans(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, float("inf"), -float("inf"), 5.0])
    for p in (0.3, 0.5, 0.6):
        both = [quantile_table(df, lay, F.col("score"), {"q": p}).first()["q"] for lay in (WHOLE, Layout(block_rows=2))]
        assert both[0] == pytest.approx(both[1])


def test_bootstrap_of_offset_data(spark):
    values = np.random.default_rng(1).normal(size=200)
    made = []
    for offset in (0.0, 1e9):
        df = series(spark, values + offset)
        df = df.withColumns({"split": F.when(F.col("pos") < 120, "train").otherwise("test"), "split_pos": F.col("pos") % 120,
                             "split_n": F.when(F.col("pos") < 120, 120).otherwise(80).cast("long")})
        out = weighted_moments_interval(df, WHOLE, F.col("score"), 10).orderBy("pos").collect()
        made.append([r["mean_score"] for r in out])
    assert np.allclose(made[0], made[1], rtol=1e-5, atol=1e-5)


def test_scratch_tables_can_be_cleared(spark):
    import os
    held = cut_lineage(spark.range(3), "kept-for-now")
    assert held.count() == 3 and any(n.startswith("kept-for-now") for n in os.listdir(shared_folder(spark)))
    assert clear_scratch(spark) > 0
    assert not any(n.startswith("kept-for-now") for n in os.listdir(shared_folder(spark)))


def test_sweep_takes_any_methods(spark):
    from alarmspan.config import SamplingConfig
    from alarmspan.plans.sweeps import sampling_sweep
    rng = np.random.default_rng(2)
    df = series(spark, rng.normal(10, 1, 400)).select("series_id", "ts", F.col("score").alias("value")).withColumn(
        "failure_time", F.timestamp_seconds(F.lit(400 * 60)))
    small = SamplingConfig(factors=(1, 2), modes=("decimate",))
    names = ("three_sigma", "ewma", "hotelling_t2", "isolation_forest")
    lay = Layout(max_rows=400)
    full = sampling_sweep(df, lay, ["value"], small, methods=names, options={"isolation_forest": {"n_estimators": 20}}).collect()
    assert {(r["factor"], r["method"]) for r in full} == {(f, m) for f in (1, 2) for m in names}
    plain = {(r["factor"], r["method"]): r for r in sampling_sweep(df, lay, ["value"], small).collect()}
    assert all(plain[r["factor"], r["method"]] == r for r in full if r["method"] in ("three_sigma", "ewma"))


def test_smoothing_in_closed_form_skips_gaps():
    from alarmspan.streaming.online import smoothed
    rng = np.random.default_rng(8)
    values, known = rng.normal(size=5000), rng.random(5000) > 0.1
    for start in (None, 3.0):
        x, want = start, []
        for v, k in zip(values, known):
            if k:
                x = v if x is None else 0.2 * v + 0.8 * x
            want.append(np.nan if x is None else x)
        assert np.allclose(smoothed(np.where(known, values, 0.0), known, 0.2, start), want, equal_nan=True)


def test_wide_rows_make_shorter_blocks(spark, monkeypatch):
    from alarmspan import layout
    monkeypatch.setattr(layout, "BLOCK_BYTES", 100_000)
    df = spark.range(500).select(F.lit("a").alias("series_id"), F.timestamp_seconds("id").alias("ts"),
                                 F.array_repeat(F.lit(1.0), 400).alias("features"))
    lay = layout.Layout.measure(df)
    assert lay.max_rows == 500 and lay.block_rows == 100_000 // (400 * 8 + 16 + 8 + 17) and not lay.whole
    assert layout.Layout.measure(df.drop("features")).whole


def test_parameters_are_shipped_by_their_unpacked_size(spark, tmp_path):
    from alarmspan.detectors import chunks
    path = str(tmp_path / "flat")
    spark.range(1000).select(F.array_repeat(F.lit(1.0), 1000).alias("values")).write.parquet(path)  # packs to next to nothing
    table = spark.read.parquet(path)
    assert not chunks.fits(table, 1 << 20) and chunks.fits(table, 1 << 24)


def test_whole_series_are_dealt_by_rows(spark):
    rows = [(s, float(s * 1_000 + t)) for s in range(100) for t in range(10)]
    df = spark.createDataFrame(rows, "series_id long, value double").withColumn("ts", F.timestamp_seconds("value"))
    lay = Layout.measure(df, block_rows=50)
    assert lay.whole and lay.rows == 1000 and lay.tasks == 40 and lay.by("method").tasks is None
    assert Layout.measure(df).tasks is None
    many, few = with_position(df, lay), with_position(df, Layout.measure(df))
    assert many.rdd.getNumPartitions() == 40
    assert sorted(many.collect()) == sorted(few.collect())
