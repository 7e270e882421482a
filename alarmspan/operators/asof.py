"""Nearest-in-time lookups and aligned joins."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators.ordered import carry, settle, with_position


def asof_nearest(left: DataFrame, right: DataFrame, lay: Layout, cols: list[str],
                 tolerance_seconds: float | None = None) -> DataFrame:
    """Add the right side's ``cols`` from the row nearest in time; the later one on a tie, null out of tolerance.

    Both sides are merged into one ordered stream and the neighbours carried along it, so the work is linear in the
    rows however dense a moment is (a bucket join would pair all rows of a bucket).
    """
    keys, ts = list(lay.keys), lay.order
    payload = F.struct(F.unix_micros(F.col(ts)).alias("t"), *cols)
    kept = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.struct(*kept).alias("_l") if kept else F.struct(F.lit(1).alias("_")).alias("_l"),
                    F.lit(1).alias("_side"))
    b = right.select(*keys, ts, payload.alias("_r"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    merged = lay if lay.max_rows is None else replace(lay, max_rows=2 * lay.max_rows, rows=lay.rows and 2 * lay.rows)
    both = settle(with_position(both, merged, "_pos", "_n", tie=["_side"]), merged, "asof")
    both = carry(both, merged, {"_prev": F.col("_r")}, {"_next": F.col("_r")}, "_pos").where("_side = 1")
    now = F.unix_micros(F.col(ts))
    before, after = now - F.col("_prev.t"), F.col("_next.t") - now
    best = F.when(F.col("_next").isNull() | (before == 0) | (before < after), F.col("_prev")).otherwise(F.col("_next"))
    if tolerance_seconds is not None:
        best = F.when(F.abs(best["t"] - now) <= F.lit(int(tolerance_seconds * 1e6)), best)
    out = both.withColumn("_best", best)
    return out.select(*keys, ts, *[F.col("_l")[c].alias(c) for c in kept], *[F.col("_best")[c].alias(c) for c in cols])


def union_logs(first: DataFrame, second: DataFrame, phases: tuple[str, str] = ("operating", "post_shutdown")) -> DataFrame:
    """Both logs tagged with their phase; columns missing on one side become null."""
    return (first.withColumn("phase", F.lit(phases[0]))
                 .unionByName(second.withColumn("phase", F.lit(phases[1])), allowMissingColumns=True))


def log_gap_seconds(before: DataFrame, after: DataFrame, ts: str = "ts") -> DataFrame:
    """Seconds from the last reading of one log to the first of the next (one row)."""
    last = before.agg(F.max(ts).alias("a"), F.lit(None).cast("timestamp").alias("b"))
    first = after.agg(F.lit(None).cast("timestamp").alias("a"), F.min(ts).alias("b"))
    ends = last.unionByName(first).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return ends.select(((F.unix_micros("b") - F.unix_micros("a")) / F.lit(1e6)).alias("gap_seconds"))
