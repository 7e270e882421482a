"""Alarm streams: exceedance with persistence, episodes, first sustained exceedance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators.ordered import carry, rolling, run_length, with_totals


def persistence_filter(df: DataFrame, lay: Layout, hit: Column, persistence: Column | int = 3, out: str = "alarm",
                       pos: str = "pos") -> DataFrame:
    """Keep runs of at least ``persistence`` consecutive hits, marked from the start of the run; 1 or less keeps all."""
    hit = F.coalesce(hit, F.lit(False))
    if isinstance(persistence, int) and persistence <= 1:
        return df.withColumn(out, hit)
    need = F.lit(persistence) if isinstance(persistence, int) else persistence
    runs = run_length(df.withColumn("_raw", hit), lay, F.col("_raw"), "_run", pos)
    return runs.withColumn(out, F.col("_raw") & (F.col("_run") >= need)).drop("_run", "_raw")


def alarm_signal(df: DataFrame, lay: Layout, threshold: Column, persistence: Column | int = 3, score: str = "score",
                 out: str = "alarm", pos: str = "pos") -> DataFrame:
    """Scores strictly above the threshold, kept where they persist."""
    return persistence_filter(df, lay, F.col(score) > threshold, persistence, out, pos)


def alarm_episodes(df: DataFrame, lay: Layout, alarm: str = "alarm", pos: str = "pos") -> DataFrame:
    """One row per alarm episode: [first alarmed ts, next non-alarmed ts); an open tail closes at the last ts."""
    ts = lay.order
    clear = F.when(~F.col(alarm), F.struct(F.col(ts).alias("ts"), F.col(pos).alias("pos")))
    ended = carry(df, lay, None, {"_clear": clear}, pos)
    ended = with_totals(ended, lay, {"_last": F.max(ts), "_rows": F.max(F.col(pos) + 1)})
    before = {"_was": lambda w: F.lag(alarm).over(w)}
    starts = rolling(ended, lay, 1, 0, [before], pos).where(F.col(alarm) & ~F.coalesce("_was", F.lit(False)))
    return starts.select(*lay.keys, F.col(ts).alias("start_ts"), F.coalesce("_clear.ts", "_last").alias("end_ts"),
                         (F.coalesce("_clear.pos", "_rows") - F.col(pos)).alias("steps"),
                         F.col("_clear").isNull().alias("open_end"))


def first_sustained(df: DataFrame, lay: Layout, hit: Column, steps: int = 5, pos: str = "pos") -> DataFrame:
    """First timestamp that opens ``steps`` consecutive hits, per series (null when there is none)."""
    ok = F.coalesce(hit, F.lit(False))
    ahead = {"_ok": lambda w: F.sum(ok.cast("int")).over(w.rowsBetween(0, steps - 1))}
    found = rolling(df, lay, 0, steps - 1, [ahead], pos)
    return found.groupBy(*lay.keys).agg(F.min(F.when(F.col("_ok") == steps, F.col(lay.order))).alias("first_alarm"))
