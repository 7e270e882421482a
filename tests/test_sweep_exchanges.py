"""What the rate sweep hands over its exchanges when series are not whole."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from alarmspan.config import SamplingConfig
from alarmspan.layout import Layout
from alarmspan.operators.features import common_divisor, rolling_features
from alarmspan.operators.ordered import with_position, with_totals
from alarmspan.plans.sweeps import RATE_KEYS, at_every_rate, rate_table, sampling_sweep
from alarmspan.session import cut_lineage

WHOLE, BLOCKS = Layout(max_rows=1000), Layout(block_rows=40, cell_us=1_800_000_000)


def readings(spark, n=311, seed=4):
    x = np.random.default_rng(seed).normal(50, 9, size=(2, n))
    rows = [(s, 60 * i * (s + 1) + 7 * s, float(v)) for s in range(2) for i, v in enumerate(x[s])]
    return spark.createDataFrame(rows, "series_id long, at long, value double").select(
        "series_id", F.timestamp_seconds("at").alias("ts"), "value", F.timestamp_seconds(F.lit(n * 120)).alias("failure_time"))


def exchanges(df) -> int:
    return sum("Exchange hashpartitioning" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_rows_meet_their_windows_over_one_exchange(spark):
    sizes = {0: (10, 5), 1: (5, 2)}
    made = {}
    for lay in (WHOLE, BLOCKS):
        placed = cut_lineage(with_position(readings(spark), lay), "placed")
        size = lambda i: F.when(F.col("series_id") == 0, sizes[0][i]).otherwise(sizes[1][i]).cast("long")
        rows = placed.withColumns({"win": size(0), "stp": size(1), "gcd": common_divisor(size(0), size(1))})
        windows = rolling_features(rows, lay, ["value"], F.col("win"), step=F.col("stp"), pane=F.col("gcd"))
        assert lay.whole or exchanges(windows) == 1
        made[lay.whole] = windows.toPandas().sort_values(["series_id", "w"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(made[True], made[False], rtol=1e-9, atol=1e-9)
    assert made[True].groupby("series_id").w.max().tolist() == [(311 - w) // s for w, s in sizes.values()]


def test_kept_rows_have_their_number_from_the_old_one(spark):
    for lay in (WHOLE, BLOCKS):
        placed = cut_lineage(with_position(readings(spark), lay), "placed")
        rates = rate_table(placed, lay, SamplingConfig(factors=(1, 3, 5)))
        rows = at_every_rate(placed, lay, rates, ["value"])
        keys = [*lay.keys, *RATE_KEYS]
        again = rows.withColumns({"p": F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1,
                                  "m": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        assert again.count() > 1000 and again.where("pos <> p or n <> m or pos is null or n is null").count() == 0


def test_small_totals_go_to_the_rows(spark):
    rows = cut_lineage(with_position(readings(spark), BLOCKS), "placed")
    out = with_totals(rows, BLOCKS, {"most": F.max("value")})
    assert exchanges(out) == 0
    assert out.where("value > most").count() == 0 and out.select("most").distinct().count() == 2


def test_large_totals_meet_cells(spark):
    rows = cut_lineage(with_position(readings(spark), BLOCKS), "placed")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_totals(rows, BLOCKS, {"most": F.max("value")})
        assert "_total_cell" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(out.select("series_id", "pos", "most").collect()) == sorted(
            with_totals(rows, WHOLE, {"most": F.max("value")}).select("series_id", "pos", "most").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_sweep_is_the_same_in_blocks(spark):
    cfg = SamplingConfig(factors=(1, 2))
    made = [sampling_sweep(readings(spark), lay, ["value"], cfg).toPandas().sort_values(["series_id", *RATE_KEYS, "method"]).reset_index(drop=True)
            for lay in (WHOLE, BLOCKS)]
    assert len(made[0]) == 16
    pd.testing.assert_frame_equal(*made)
