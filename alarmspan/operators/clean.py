"""Gap filling, stuck-sensor masks, spike clipping, imputation, tags and numeric column choice."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmspan.functions.stats import finite
from alarmspan.layout import Layout
from alarmspan.operators.ordered import carry, rolling, trailing_moments, with_totals

# Severity limits in mm/s and hours before failure that open a degradation phase.
SEVERITY_LIMITS = {"alert": 7.1, "alarm": 11.2, "danger": 18.0}
PHASE_HOURS = {"Degrading": 72.0, "Critical": 24.0}


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("series_id", "pos", "n", "hours_to_failure")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def columns_with_prefix(columns: list[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]


def fill_forward_backward(df: DataFrame, lay: Layout, cols: list[str], max_gap: int = 5) -> DataFrame:
    """Carry the last value at most ``max_gap`` rows on, then the next one at most ``max_gap`` rows back; drop rows
    that still hold a null.  Needs ``pos``."""
    forward = {f"_{c}": (lambda w, c=c: F.last(c, ignorenulls=True).over(w.rowsBetween(-max_gap, 0))) for c in cols}
    backward = {c: (lambda w, c=c: F.first(f"_{c}", ignorenulls=True).over(w.rowsBetween(0, max_gap))) for c in cols}
    filled = rolling(df, lay, 2 * max_gap, 2 * max_gap, [forward, backward])
    return filled.drop(*[f"_{c}" for c in cols]).dropna("any", subset=cols)


def fill_interpolate(df: DataFrame, lay: Layout, cols: list[str], max_gap: int = 5) -> DataFrame:
    """Linear in time, at most ``max_gap`` rows into a gap; a trailing gap repeats the last value; remaining nulls
    drop the row.  Needs ``pos``."""
    ts = F.col(lay.order)
    seen = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.unix_micros(ts).alias("t"),
                                                     F.col(c).alias("v"))) for c in cols}
    both = carry(df, lay, {f"_b_{c}": s for c, s in seen.items()}, {f"_a_{c}": s for c, s in seen.items()})
    now = F.unix_micros(ts)
    new = {}
    for c in cols:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        inside = b["v"] + (a["v"] - b["v"]) * ((now - b["t"]) / (a["t"] - b["t"]))
        near = F.col("pos") - b["p"] <= max_gap
        new[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                   .when(b.isNull() | ~near, F.lit(None))
                   .when(a.isNull(), b["v"]).otherwise(inside))
    return both.withColumns(new).drop(*[f"_{s}_{c}" for s in "ab" for c in cols]).dropna("any", subset=cols)


def fill_missing(df: DataFrame, lay: Layout, cols: list[str], method: str = "ffill", max_gap: int = 5) -> DataFrame:
    """``ffill``, ``interpolate``, or anything else to drop rows with nulls."""
    if method == "ffill":
        return fill_forward_backward(df, lay, cols, max_gap)
    if method == "interpolate":
        return fill_interpolate(df, lay, cols, max_gap)
    return df.dropna("any", subset=cols)


def fill_unlimited(df: DataFrame, lay: Layout, cols: list[str]) -> DataFrame:
    """Carry the last value on without limit, then the first value back to the start."""
    both = carry(df, lay, {f"_b_{c}": F.col(c) for c in cols}, {f"_a_{c}": F.col(c) for c in cols})
    return (both.withColumns({c: F.coalesce(f"_b_{c}", f"_a_{c}") for c in cols})
                .drop(*[f"_{s}_{c}" for s in "ab" for c in cols]))


def stuck_mask(df: DataFrame, lay: Layout, cols: list[str], window: int = 20, tol: float = 1e-9) -> DataFrame:
    """``stuck_<c>``: the trailing sample deviation over a full window is below ``tol``."""
    rows = trailing_moments(df, lay, window, {str(i): F.col(c) for i, c in enumerate(cols)})
    for i, c in enumerate(cols):
        n = F.col(f"_count_{i}")
        deviation = F.sqrt(F.try_divide(F.col(f"_var_{i}") * n, n - 1))
        rows = rows.withColumn(f"stuck_{c}", F.coalesce((n == window) & (deviation < tol), F.lit(False)))
    return rows.drop(*[f"_{k}_{i}" for k in ("count", "var") for i in range(len(cols))])


def clip_spikes(df: DataFrame, lay: Layout, cols: list[str], z: float = 10.0) -> DataFrame:
    """Clip each column to mean +- z sample deviations of its series; rows are kept."""
    totals = {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": F.stddev_samp(c) for c in cols}
    wide = with_totals(df, lay, totals)
    def clipped(c: str) -> Column:
        low, high = F.col(f"_m_{c}") - z * F.col(f"_s_{c}"), F.col(f"_m_{c}") + z * F.col(f"_s_{c}")
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), low), high))
    return wide.withColumns({c: clipped(c) for c in cols}).drop(*totals)


def impute_mean(df: DataFrame, lay: Layout, cols: list[str], split: str = "split") -> DataFrame:
    """Replace null and non-finite cells by the mean of the finite cells of the same series and split."""
    wide = with_totals(df, lay.by(split), {f"_m_{c}": F.avg(finite(F.col(c))) for c in cols})
    return wide.withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"_m_{c}")) for c in cols}) \
               .drop(*[f"_m_{c}" for c in cols])


def severity_zone(value: Column) -> Column:
    lim = SEVERITY_LIMITS
    return (F.when(value >= lim["danger"], "danger").when(value >= lim["alarm"], "alarm")
             .when(value >= lim["alert"], "alert").otherwise("normal"))


def degradation_phase(hours_to_failure: Column) -> Column:
    """Normal, Degrading (last 72 h) or Critical (last 24 h) by hours relative to failure."""
    return (F.when(hours_to_failure < -PHASE_HOURS["Degrading"], "Normal")
             .when(hours_to_failure < -PHASE_HOURS["Critical"], "Degrading").otherwise("Critical"))


def last_hours(df: DataFrame, lay: Layout, hours: float | None, end: str = "failure_time") -> DataFrame:
    """Rows of the last ``hours`` before ``end``; everything for None."""
    if hours is None:
        return df
    # Compared as timestamps, so that the bound reaches the Parquet scan when ``end`` is a constant.
    return df.where(F.col(lay.order) >= F.col(end) - F.make_dt_interval(secs=F.lit(hours * 3600.0).cast("decimal(18,6)")))
