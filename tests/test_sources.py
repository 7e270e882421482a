"""File sources, processed tables and end-to-end plans on files written by the test."""
import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.config import ExperimentConfig, FeatureConfig, ModelConfig
from alarmspan.layout import Layout
from alarmspan.operators.ordered import with_position
from alarmspan.plans import evaluate, pipeline, sweeps
from alarmspan.sources import logs, processed, waveform

LAY = Layout(max_rows=2000)


def test_waveform_snapshots(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {}
    for run, width in (("first", 3), ("second", 2)):
        os.makedirs(tmp_path / run)
        for k in range(3):
            x = rng.normal(size=(50, width))
            data[run, k] = x
            sep = "\t" if k == 1 else "  "
            (tmp_path / run / f"2004.02.12.10.3{k}.39").write_text("\n".join(sep.join(f"{v:.10f}" for v in r) for r in x) + "\n")
    (tmp_path / "first" / "2004.02.12.11.00.00").write_text("1 2 3\n4 5\n")
    (tmp_path / "first" / "2004.02.12.12.00.00").write_text("1 2 oops\n")
    (tmp_path / "second" / "2004.02.12.13.00.00").write_text("3.0 4.0\n")
    os.makedirs(tmp_path / "third")
    for k in range(25):
        (tmp_path / "third" / f"snap{k:03d}").write_text(f"{k}.0 1.0\n")
    table = waveform.snapshot_table(spark, str(tmp_path), ["first", "second", "absent"], n_channels=2)
    rows = {(r.series_id, r.ts.strftime("%H:%M:%S")): r for r in table.collect()}
    assert len(rows) == 7
    row, x = rows["first", "10:31:00"], data["first", 1]
    assert row.rms_ch1 == pytest.approx(np.sqrt((x[:, 1] ** 2).mean())) and row.var_ch0 == pytest.approx(x[:, 0].var())
    assert row.crest_ch0 == pytest.approx(abs(x[:, 0]).max() / np.sqrt((x[:, 0] ** 2).mean()))
    z = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()
    assert row.kurt_ch0 == pytest.approx((z ** 4).mean() - 3) and row.skew_ch0 == pytest.approx((z ** 3).mean())
    assert rows["second", "13:00:00"].rms_ch1 == 4.0 and rows["second", "13:00:00"].kurt_ch0 == 0.0
    samples = waveform.waveform_samples(spark, str(tmp_path), ["first", "second"], 2)
    assert samples.select("path").distinct().count() == 7 and samples.count() == 6 * 50 * 2 + 2
    counted = waveform.snapshot_table(spark, str(tmp_path), ["first", "third"], 2).where("series_id = 'third'").collect()
    assert {r.ts: r.rms_ch0 for r in counted} == {dt.datetime(2003, 10, 22, 0, k): float(k) for k in range(25)}
    with pytest.raises(FileNotFoundError):
        waveform.snapshot_table(spark, str(tmp_path), ["absent"])


def test_turbine_log(spark, tmp_path):
    start = dt.datetime(2023, 11, 10)
    head = "Time Stamp,LPC_DE_X_Vib,LPC_DE_Y_Vib,LPC_NDE_X_Vib,LPC_NDE_Y_Vib,Ncp,Unnamed: 6"
    line = lambda t, i: f"{t:%d-%m-%Y}# {t:%H:%M:%S},{i},{i+1},{i+2},{i+3},102,"
    before, after = tmp_path / "before.csv", tmp_path / "after.csv"
    before.write_text("\n".join([head] + [line(start + dt.timedelta(seconds=10 * i), i) for i in range(100)]) + "\n")
    after.write_text("\n".join([head] + [line(start + dt.timedelta(seconds=2000 + 10 * i), i) for i in range(5)]) + "\n")
    rows, gap = logs.turbine_log(spark, str(before), str(after), "2023-11-10 00:15:00")
    assert {r[0]: r[1] for r in rows.groupBy("split").count().collect()} == {"train": 60, "test": 40}
    assert gap.first().gap_seconds == 1010.0 and "Ncp" not in rows.columns
    with pytest.raises(Exception, match="outside the test span"):
        logs.turbine_log(spark, str(before), None, "2023-11-10 00:00:10")[0].collect()
    assert logs.channel_table(spark).count() == 5


def test_tolerant_log(spark, tmp_path):
    p = tmp_path / "odd.csv"
    p.write_text("When,vib NDE_X (mm/s),vib DE_X,Empty,vib DE_X,Speed rpm\n13-11-2023# 09:46:00,3,1,,9,102\nbad,4,2,,9,101\n2023-11-13 09:45,5,3,,9,100\n")
    rows = logs.tolerant_log(spark, str(p)).orderBy("ts").collect()
    assert [tuple(r) for r in rows] == [("log", dt.datetime(2023, 11, 13, 9, 45), 5.0, 3.0, 100.0), ("log", dt.datetime(2023, 11, 13, 9, 46), 3.0, 1.0, 102.0)]
    assert rows[0].asDict().keys() == {"series_id", "ts", "LPC_NDE_X_Vib", "LPC_DE_X_Vib", "Ncp"}


def series(spark, names=("a", "b"), n=400, jump=True):
    rng = np.random.default_rng(4)
    rows = []
    for s in names:
        for i in range(n):
            level = 1.0 + (3.0 if jump and i > 0.9 * n else 0.0)
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), *(float(level + v) for v in rng.normal(size=2) * .2)))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, x double, y double")


def runs_of(spark, names=("a", "b"), n=400):
    end = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * n)
    return spark.createDataFrame([(s, end) for s in names], "series_id string, failure_time timestamp")


def test_processed_tables_are_reused(spark, tmp_path):
    root = str(tmp_path / "processed")
    df = series(spark)
    first = processed.read_or_build(spark, df.where("series_id = 'a'"), root, runs_of(spark), 20.0)
    assert first.count() == 200 and first.agg(F.max("hours_to_failure")).first()[0] < 0
    both = processed.read_or_build(spark, df, root, runs_of(spark), 20.0)
    assert {r[0]: r[1] for r in both.groupBy("series_id").count().collect()} == {"a": 200, "b": 200}
    assert processed.read_or_build(spark, df, root, None, 60.0).where("series_id = 'a'").count() == 67
    assert dict(both.dtypes)["x"] == "double" and dict(both.dtypes)["ts"] == "timestamp"
    out = str(tmp_path / "csv")
    processed.write_csv(both, out)
    assert spark.read.option("header", True).csv(out).count() == 400


def test_processed_tables_follow_their_source(spark, tmp_path):
    root, df = str(tmp_path / "processed"), series(spark)
    half = df.where("series_id = 'b' OR ts < TIMESTAMP '2024-01-02'")
    build = lambda rows, **how: {r["series_id"]: r["count"] for r in processed.read_or_build(
        spark, rows, root, None, 20.0, **how).groupBy("series_id").count().collect()}
    versions = lambda: spark.read.parquet(f"{root}/manifest/freq=20min").groupBy("version").count().orderBy("version").collect()
    early = build(half)
    assert early["a"] < build(df)["a"] == 200 and early["b"] == 200
    assert [tuple(r) for r in versions()] == [(1, 2), (2, 1)]   # only the series with later rows
    changed = df.withColumn("x", F.when(F.col("ts") == F.lit("2024-01-01 00:00:00").cast("timestamp"), 3.25).otherwise(F.col("x")))
    build(df)
    assert len(versions()) == 2                                  # nothing is out of date
    build(changed)
    assert len(versions()) == 3                                  # a value was replaced
    build(changed, z=3.0)
    assert [r["count"] for r in versions()][-1] == 2             # other options


CFG = ExperimentConfig(models=ModelConfig(methods=("three_sigma", "ewma")))


def test_experiment_detects_the_jump_and_keys_are_independent(spark):
    df, runs = series(spark), runs_of(spark)
    both = {(r.series_id, r.method): r for r in pipeline.run_experiment(df, LAY, ["x", "y"], runs, CFG).collect()}
    assert len(both) == 4 and all(r.valid_alarm for r in both.values())
    assert all(0 <= r.far_pct <= 100 and 5 < r.vlt_hours < 30 for r in both.values())
    alone = pipeline.run_experiment(df.where("series_id = 'b'"), LAY, ["x", "y"], runs, CFG).collect()
    for r in alone:
        assert r.asDict() == both[r.series_id, r.method].asDict()
    blocks = pipeline.run_experiment(df, Layout(block_rows=50), ["x", "y"], runs, CFG).collect()
    for r in blocks:
        a, b = r.asDict(), both[r.series_id, r.method].asDict()
        assert {k: v for k, v in a.items() if k != "threshold"} == {k: v for k, v in b.items() if k != "threshold"}
        assert a["threshold"] == pytest.approx(b["threshold"], abs=2e-4)


def test_earlier_failure_never_lengthens_the_lead(spark):
    df = evaluate.split_rows(with_position(series(spark), LAY))
    last = None
    for hours in (80, 64, 62, 40):
        end = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
        scored = evaluate.closed_form_scores(df.withColumn("failure_time", F.lit(end)), LAY, ["x", "y"])
        now = {(r.series_id, r.method): r.vlt_hours for r in evaluate.evaluate_scores(scored, LAY.by("method")).collect()}
        assert all(v >= 0 for v in now.values()) and (last is None or all(now[k] <= last[k] for k in now))
        last = now


def test_sweep_at_factor_one_is_the_plain_pipeline(spark):
    df, runs = series(spark), runs_of(spark)
    plain = {(r.series_id, r.method): r for r in pipeline.run_experiment(df, LAY, ["x", "y"], runs, CFG).collect()}
    sweep = sweeps.sampling_sweep(df.join(runs, "series_id"), LAY, ["x", "y"]).cache()
    for r in sweep.where("factor = 1").collect():
        p = plain[r.series_id, r.method]
        assert (r.vlt_hours, r.far_pct, r.fat, r.valid_alarm) == (p.vlt_hours, p.far_pct, p.fat, p.valid_alarm)
    agg = sweeps.sampling_aggregate(sweep, LAY).collect()
    assert len(agg) == 20 and all(r.n_runs == 2 for r in agg)


def test_rate_reduction_and_scales(spark):
    df = series(spark)
    placed = with_position(df, LAY)
    assert pipeline.reduce_rate(placed, LAY, ["x"], 4, "decimate").count() == 200
    assert pipeline.reduce_rate(placed, LAY, ["x"], 4, "aggregate").count() == 200
    with pytest.raises(ValueError):
        pipeline.reduce_rate(placed, LAY, ["x"], 4, "other")
    flat, names = pipeline.feature_pipeline(df, LAY, ["x", "y"], CFG, overlap=0.0)
    assert flat.where("series_id = 'a'").count() == 40 and len(names) == 16
    table = pipeline.compare_scales(df, LAY, ["x", "y"], runs_of(spark), {"w10": (10,), "fused": (5, 10, 20)}, CFG).collect()
    assert {(r.scale, r.method) for r in table} == {(s, m) for s in ("w10", "fused") for m in ("three_sigma", "ewma")}


def test_time_bound_and_columns_reach_the_scan(spark, tmp_path):
    from alarmspan.operators.clean import last_hours
    path = str(tmp_path / "t")
    series(spark).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("failure_time", F.lit(dt.datetime(2024, 1, 3)))
    out = last_hours(rows, LAY, 12.5).select("series_id", "x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-02 11:30:00" in plan and "ReadSchema: struct<series_id:string,ts:timestamp,x:double>" in plan
    assert out.count() == 2 * (400 - 213)
    assert last_hours(rows, LAY, None).count() == 800
