"""Uniform grids, rate reduction and the row counts that keep wall-clock durations constant."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.layout import DAY_US, Layout
from alarmspan.operators.ordered import rolling, with_totals
from alarmspan.operators.quantile import quantile_table

MINUTE_US = 60_000_000


def bin_start(ts: Column, first_ts: Column, width_us: Column) -> Column:
    """Left edge of the bin: bins start at midnight of the day of the first reading, so widths that do not divide a
    day stay aligned to the series rather than to the epoch."""
    origin = F.unix_micros(first_ts) - F.pmod(F.unix_micros(first_ts), F.lit(DAY_US))
    since = F.unix_micros(ts) - origin
    return F.timestamp_micros(origin + (since - F.pmod(since, width_us)))


def resample_mean(df: DataFrame, lay: Layout, cols: list[str], minutes: Column | float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mean per uniform bin; bins where every column is null are dropped.  ``minutes`` may be a per-series column.

    Only min(ts) needs the whole series; the bins themselves are aggregated with map-side combine.
    """
    width = (minutes if isinstance(minutes, Column) else F.lit(float(minutes))).cast("double") * F.lit(float(MINUTE_US))
    first = with_totals(df, lay, {"_first": F.min(lay.order)})
    binned = first.withColumn("_bin", bin_start(F.col(lay.order), F.col("_first"), width.cast("long")))
    grid = binned.groupBy(*lay.keys, *carry, F.col("_bin").alias(lay.order)).agg(*[F.avg(c).alias(c) for c in cols])
    return grid.dropna("all", subset=cols)


def decimate(df: DataFrame, k: Column | int) -> DataFrame:
    """Keep every k-th row from the first (needs ``pos``)."""
    return df.where(F.col("pos") % (F.lit(k) if isinstance(k, int) else k) == 0)


def median_spacing(df: DataFrame, lay: Layout) -> DataFrame:
    """Median minutes between consecutive readings per series; null below two rows (needs ``pos``)."""
    step = {"_gap_us": lambda w: F.unix_micros(F.col(lay.order)) - F.unix_micros(F.lag(lay.order).over(w))}
    gaps = rolling(df, lay, 1, 0, [step])
    return quantile_table(gaps, lay, F.col("_gap_us") / F.lit(6e7), {"spacing_min": 0.5})


def derive_counts(df: DataFrame, base_min: Column, factor: Column, window_minutes: Column,
                  persistence_minutes: Column, overlap: float = 0.5, min_window_rows: int = 3) -> DataFrame:
    """Window and persistence row counts at each sampling rate, from durations held constant in wall-clock time."""
    effective = base_min * factor
    raw = F.bround(window_minutes / effective).cast("long")
    rows = F.greatest(F.lit(min_window_rows).cast("long"), raw)
    stride = F.greatest(F.lit(1).cast("long"), F.bround(rows * F.lit(1.0 - overlap)).cast("long"))
    return (df.withColumns({"effective_min": effective, "window_floored": raw < min_window_rows,
                            "window_rows": rows, "stride_rows": stride})
              .withColumn("persistence_windows", F.greatest(
                  F.lit(1).cast("long"),
                  F.bround(persistence_minutes / (F.col("stride_rows") * F.col("effective_min"))).cast("long"))))
