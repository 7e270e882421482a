"""Registered queries against DuckDB, in the whole and the block plan, and checks of their plans."""
import os
import shutil

import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries
from alarmspan.catalog import load_catalog, views
from alarmspan.layout import Layout

SF = "/root/testdata/sf0.001"
# The package's own catalog; tests of the training-data subpackage lie with it.
QUERIES, SQL = load_catalog()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ok, note = check_oracle.compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, note


# Queries whose operators change plan with the layout; the sweep's nested block plan has its own test of parts.
BLOCKED = ("lead_time_three_sigma", "threshold_sweep", "fill_ffill", "fill_interpolate", "stuck_mask", "scale_robust",
           "window_features", "multiscale_features", "asof_nearest", "alarm_episodes", "conformal_pvalues", "rolling_trend",
           "dynamic_threshold", "behaviour", "lagged_ccf", "median_spacing", "bootstrap_interval")


@pytest.mark.parametrize("name", BLOCKED)
def test_block_plan_matches_sql(spark, con, name, monkeypatch):
    monkeypatch.setattr(views, "measured", lambda *a, **k: Layout(block_rows=16, cell_us=3 * 86_400_000_000))
    ok, note = check_oracle.compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() == 15
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


PYTHON_QUERIES = {"pair_p_values", "hotelling_t2", "t2_limits", "isolation_forest", "one_class_rff", "sequence_error",
                  "forest_attribution", "bootstrap_forest", "model_comparison", "health_alert", "event_summary",
                  "model_sweep", "model_experiment", "model_scales", "conformal_forest",
                  "lagged_ccf", "lead_lag", "influence_summary"}  # lags by convolution
STREAMS = {"stream_resample", "stream_features", "stream_alarm"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_QUERIES - STREAMS))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "FlatMapGroupsInPandas"):
        assert banned not in plan, banned


def test_one_exchange_for_the_flagship(spark):
    plan = QUERIES["lead_time_three_sigma"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_stream_in_many_batches_equals_one(spark, tmp_path):
    from pyspark.sql import functions as F
    from alarmspan.streaming import online
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i in range(4):  # files in time order, so that no row is late
        part = events.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
        part.coalesce(1).write.parquet(f"{folder}/p{i}")
        src = next(f for f in os.listdir(f"{folder}/p{i}") if f.endswith(".parquet"))
        shutil.move(f"{folder}/p{i}/{src}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i * 60,) * 2)
        shutil.rmtree(f"{folder}/p{i}")
    def run(per_batch):
        rows = online.file_stream(spark, folder, "*.parquet", per_batch)
        stream = rows.select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"),
                             F.col("value").alias("score"), F.lit(15.0).alias("threshold"))
        alarm = online.run_available(online.online_alarm(stream), "t-alarm")
        alarm = alarm.unionByName(online.close_alarm(spark.read.parquet(f"{folder}/*.parquet").select(
            F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"),
            F.lit(15.0).alias("threshold")), alarm)).orderBy("series_id", "row").toPandas()
        grid = online.run_available(online.stream_resample(stream, ["score"], "6 hours", "1 hour"), "t-grid")
        return alarm, grid.orderBy("series_id", "ts").toPandas()
    (a1, g1), (a4, g4) = run(None), run(1)
    import pandas as pd
    pd.testing.assert_frame_equal(a1, a4)
    pd.testing.assert_frame_equal(g1, g4)
    fired = a1[a1.alarm & (a1.run == 3)]
    assert len(fired) and (fired.run_start < fired.ts).all()


@pytest.mark.parametrize("models, closed, keys", [
    ("model_experiment", "experiment_metrics", ["series_id", "method"]),
    ("model_sweep", "sampling_sweep", ["series_id", "mode", "factor", "method"])])
def test_all_methods_hold_the_closed_form_rows(spark, models, closed, keys):
    """The query over all methods gives the rows that SQL confirms for two of them, and as many for each other method."""
    import pandas as pd
    from alarmspan.config import ModelConfig
    every = QUERIES[models](spark, SF).toPandas().sort_values(keys)
    two = QUERIES[closed](spark, SF).toPandas().sort_values(keys)
    assert len(two) and set(every.method) == set(ModelConfig().methods)
    pd.testing.assert_frame_equal(every[every.method.isin(two.method)].reset_index(drop=True), two.reset_index(drop=True))
    assert every.groupby("method").size().nunique() == 1 and every.far_pct.between(0, 100).all()
    assert ((every.vlt_hours > 0) | ~every.valid_alarm).all()


def test_conformal_forest_alarms_on_small_p_values(spark):
    out = QUERIES["conformal_forest"](spark, SF).toPandas()
    assert out.series_id.is_unique and (out.threshold == 0.05).all() and out.far_pct.between(0, 100).all()
    assert (out.valid_alarm == (out.vlt_hours > 0)).all() and out[out.valid_alarm].fat.notna().all()
