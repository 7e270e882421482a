"""Block plans must equal whole-series plans and a plain sequential computation."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators import ordered, quantile

WHOLE = Layout(max_rows=1000)
BLOCKS = [Layout(block_rows=7), Layout(max_rows=300, block_rows=16, cell_us=3_600_000_000)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 120), ("b", 1), ("c", 23), ("d", 8)):
        for i in range(n):
            v = float(np.round(rng.normal(), 2))
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), None if rng.random() < .2 else v, v))
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, gap double, v double")
    return df, pd.DataFrame(rows, columns=["series_id", "ts", "gap", "v"])


def _pdf(df):
    return df.orderBy("series_id", "pos").toPandas().reset_index(drop=True)


@pytest.mark.parametrize("lay", BLOCKS)
def test_blocks_equal_whole(frame, lay):
    df, pdf = frame
    def run(lay):
        d = ordered.settle(ordered.with_position(df, lay), lay)
        d = ordered.rolling(d, lay, 9, 4, [
            {"m": lambda w: F.avg("v").over(w.rowsBetween(-9, 0))},
            {"x": lambda w: F.max("m").over(w.rowsBetween(0, 4))}])
        d = ordered.carry(d, lay, {"p": F.col("gap")}, {"f": F.col("gap")})
        d = ordered.run_length(d, lay, F.col("v") > 0, "run")
        d = ordered.settle(d, lay)
        d = ordered.ewma(d, lay, F.col("v"), 0.2, F.lit(1.5), "e")
        d = ordered.ewma(d, lay, F.col("v"), 0.003, F.lit(1.5), "slow")
        d = quantile.with_quantiles(d, lay, F.col("v"), {"q1": .25, "q9": .975})
        return _pdf(d)
    whole, blocks = run(WHOLE), run(lay)
    pd.testing.assert_frame_equal(whole, blocks[whole.columns], rtol=1e-9)
    for s, g in whole.groupby("series_id"):
        src = pdf[pdf.series_id == s].v.to_numpy()
        assert list(g.pos) == list(range(len(src))) and set(g.n) == {len(src)}
        for col, lam in (("e", .2), ("slow", .003)):
            e, out = 1.5, []
            for v in src:
                e = lam * v + (1 - lam) * e
                out.append(e)
            np.testing.assert_allclose(g[col], out, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(g.q9, np.percentile(src, 97.5), atol=1e-12)
        np.testing.assert_allclose(g.q1, np.percentile(src, 25), atol=1e-12)


def test_quantiles_with_ties_and_extremes(spark):
    rows = [("t", float(x)) for x in [5.0] * 50 + [-3.0, -2.9, 0.0, 1e9, 1e-9, -1e7]] + [("u", 2.0)]
    df = spark.createDataFrame(rows, "series_id string, v double")
    ps = {f"p{i}": p for i, p in enumerate((0.0, .01, .05, .5, .99, 1.0))}
    a = quantile.quantile_table(df, Layout(block_rows=4), F.col("v"), ps).orderBy("series_id").toPandas()
    vals = np.array([r[1] for r in rows if r[0] == "t"])
    for name, p in ps.items():
        np.testing.assert_allclose(a[name][0], np.percentile(vals, p * 100), rtol=1e-12)
        assert a[name][1] == 2.0


def test_measure_narrows_cells(spark):
    df = spark.range(3000).select(F.lit("s").alias("series_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    lay = Layout.measure(df, block_rows=100)
    assert not lay.whole and lay.cell_us <= 1_000_000_000
    assert Layout.measure(df).whole
    d = ordered.with_position(df, lay)
    assert d.where((F.unix_seconds("ts") / 10) != F.col("pos")).count() == 0
