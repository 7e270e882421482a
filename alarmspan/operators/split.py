"""Ordered splits by row fraction or by time span."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators.ordered import with_totals


def temporal_split(df: DataFrame, train: float = 0.60, cal: float = 0.20) -> DataFrame:
    """Tag rows train / cal / test by position and number them inside their split (needs ``pos`` and ``n``)."""
    n = F.col("n").cast("double")
    first_cal = F.floor(n * F.lit(train))
    first_test = F.floor(n * F.lit(train + cal))
    pos = F.col("pos")
    split = F.when(pos < first_cal, "train").when(pos < first_test, "cal").otherwise("test")
    start = F.when(pos < first_cal, F.lit(0)).when(pos < first_test, first_cal).otherwise(first_test)
    stop = F.when(pos < first_cal, first_cal).when(pos < first_test, first_test).otherwise(F.col("n"))
    return df.withColumns({"split": split, "split_pos": (pos - start).cast("long"),
                           "split_n": (stop - start).cast("long")})


def training_prefix(fraction: float, floor_rows: int = 0) -> Column:
    """True for the first ``fraction`` of rows, at least ``floor_rows`` of them (needs ``pos`` and ``n``)."""
    rows = F.greatest(F.lit(floor_rows), F.floor(F.col("n").cast("double") * F.lit(fraction)))
    return F.col("pos") < rows


def normal_end_row(fraction: float) -> Column:
    """True for the row whose timestamp ends the normal period of the test part (needs split columns)."""
    last = F.least(F.floor(F.col("split_n").cast("double") * F.lit(fraction)), F.col("split_n") - 1)
    return (F.col("split") == "test") & (F.col("split_pos") == last)


def normal_rows(fraction: float) -> Column:
    """True for the test rows up to the one that ends the normal period (needs split columns)."""
    last = F.least(F.floor(F.col("split_n").cast("double") * F.lit(fraction)), F.col("split_n") - 1)
    return (F.col("split") == "test") & (F.col("split_pos") <= last)


def with_baseline_span(df: DataFrame, lay: Layout, days: float = 2.0, out: str = "in_baseline") -> DataFrame:
    """Flag rows of the first ``days`` of a series, end included."""
    started = with_totals(df, lay, {"_start": F.min(lay.order)})
    reach = F.unix_micros(F.col(lay.order)) - F.unix_micros(F.col("_start"))
    return started.withColumn(out, reach <= F.lit(int(days * 86_400_000_000))).drop("_start")
