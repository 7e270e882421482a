"""Windows whose features hardly vary, and percentiles between equal values: no digit of their own."""
from __future__ import annotations

from functools import reduce
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators.features import SHORT_ROWS, rolling_features
from alarmspan.operators.ordered import with_position
from alarmspan.operators.quantile import quantile_table

WHOLE, BLOCKS = Layout(max_rows=1000), Layout(block_rows=40, cell_us=600_000_000)


def total(x):
    return reduce(lambda a, b: a + b, x, 0.0)


def plain(x: list[float]) -> dict[str, float]:
    """The definition, sums in the order of the rows."""
    mean = total(x) / len(x)
    d = [v - mean for v in x]
    rms, size, var = sqrt(total([v * v for v in x]) / len(x)), total([abs(v) for v in x]) / len(x), total([v * v for v in d]) / len(x)
    return {"rms_value": rms, "crest_value": max(abs(v) for v in x) / (rms + 1e-12), "p2p_value": max(x) - min(x),
            "shape_value": (rms + 1e-12) / (size + 1e-12), "var_value": var}


@pytest.mark.parametrize("lay", [WHOLE, BLOCKS], ids=["whole", "blocks"])
@pytest.mark.parametrize("window, step", [(10, 5), (3, 1)])
def test_short_windows_are_the_definition_digit_by_digit(spark, lay, window, step):
    values = np.repeat(np.random.default_rng(9).exponential(60, 12).round(2), 26).tolist()  # mostly windows of equal rows
    rows = spark.createDataFrame([(1, 60 * i, v) for i, v in enumerate(values)], "series_id long, at long, value double").select(
        "series_id", F.timestamp_seconds("at").alias("ts"), "value")
    as_col = lambda n: F.lit(n).cast("long")
    got = rolling_features(with_position(rows, lay), lay, ["value"], as_col(window), step=as_col(step), pane=as_col(1), longest=window)
    got = {r["w"]: r.asDict() for r in got.collect()}
    assert sorted(got) == list(range((len(values) - window) // step + 1))
    for w, row in got.items():
        own = values[w * step:w * step + window]
        assert {k: row[k] for k in plain(own)} == plain(own)
        assert row["ts"].timestamp() == 60 * (w * step + window // 2)
        if max(own) == min(own):
            assert (row["kurt_value"], row["skew_value"]) == (-3.0, 0.0)
        else:
            d = np.array(own) - np.mean(own)
            assert row["kurt_value"] == pytest.approx((d ** 4).mean() / d.std() ** 4 - 3, abs=1e-9)
            assert row["skew_value"] == pytest.approx((d ** 3).mean() / d.std() ** 3, abs=1e-9)


def test_short_and_merged_windows_agree(spark):
    values = [None if i % 17 == 0 else float(v) for i, v in enumerate(np.random.default_rng(5).normal(20, 7, 300))]
    rows = spark.createDataFrame([(i // 150, 60 * i, v) for i, v in enumerate(values)], "series_id long, at long, value double").select(
        "series_id", F.timestamp_seconds("at").alias("ts"), "value")
    placed = with_position(rows, BLOCKS)
    made = [rolling_features(placed, BLOCKS, ["value"], 12, longest=longest).toPandas().sort_values(["series_id", "w"]).reset_index(drop=True)
            for longest in (None, 12, SHORT_ROWS + 1)]
    assert list(made[0].columns) == list(made[1].columns) and len(made[0]) == 48
    for other in made[1:]:
        assert made[0][["series_id", "w", "ts"]].equals(other[["series_id", "w", "ts"]])
        assert np.allclose(made[0].iloc[:, 3:], other.iloc[:, 3:], rtol=1e-9, atol=1e-9)


def test_a_percentile_between_equal_values_is_that_value(spark):
    n, p = 30, 0.975
    t = p * (n - 1) % 1
    values = [v for v in np.random.default_rng(1).exponential(60, 200).round(2).tolist() if (1 - t) * v + t * v != v][:5]
    assert len(values) == 5
    rows = spark.createDataFrame([(s, v) for s, v in enumerate(values) for _ in range(n)], "series_id long, value double")
    for lay in (WHOLE, BLOCKS):
        assert {r["series_id"]: r["q"] for r in quantile_table(rows, lay, F.col("value"), {"q": p}).collect()} == dict(enumerate(values))
