"""Streaming queries over the events as a file stream, with the SQL of their batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.operators.quantile import quantile_table
from alarmspan.session import pin_utc
from alarmspan.streaming import online


def event_stream(spark, sf):
    rows = online.file_stream(pin_utc(spark), sf, "events.parquet")
    return rows.select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def stored_events(spark, sf):
    return v.table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _sql_window(width_h, slide_h, aggs):
    w, s = width_h * 3_600_000_000, slide_h * 3_600_000_000
    return f"""
sw AS (SELECT user_id AS series_id, value, unnest(generate_series(epoch_us(ts) // {s} * {s} - {w - s}, epoch_us(ts) // {s} * {s}, {s})) AS st FROM events),
sg AS (SELECT series_id, st, {aggs} FROM sw GROUP BY 1, 2)"""


@query("stream_resample", v.with_ctes(_sql_window(6, 6, "avg(value) AS value"), tail=f"SELECT series_id, {sql_stamp('make_timestamp(st)')} AS ts, {sql_r6('value')} AS value FROM sg"))
def stream_resample(spark, sf):
    means = lambda rows: online.stream_resample(rows, ["value"], "6 hours", "1 hour")
    out = online.run_available(means(event_stream(spark, sf)), "stream-resample")
    rest = online.close_windows(stored_events(spark, sf), means, "6 hours", "1 hour", F.col("ts") + F.expr("INTERVAL 6 hours"))
    return out.unionByName(rest).select("series_id", stamp("ts").alias("ts"), r6("value").alias("value"))


@query("stream_features", v.with_ctes(_sql_window(48, 24, "count(*) AS n_rows, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS p2p, max(abs(value)) / (sqrt(avg(value * value)) + 1e-12) AS crest"),
    tail=f"SELECT series_id, {sql_stamp('make_timestamp(st)')} AS start_ts, n_rows, {sql_r6('rms')} AS rms, {sql_r6('p2p')} AS p2p, {sql_r6('crest')} AS crest FROM sg"))
def stream_features(spark, sf):
    stats = lambda rows: online.stream_features(
        rows, "value", "48 hours", "24 hours", "1 hour", ("rms", "peak_to_peak", "crest_factor"))
    out = online.run_available(stats(event_stream(spark, sf)), "stream-features")
    rest = online.close_windows(stored_events(spark, sf), stats, "48 hours", "1 hour", F.col("end_ts"))
    return out.unionByName(rest).select("series_id", stamp("start_ts").alias("start_ts"), "n_rows", *[r6(c).alias(c) for c in ("rms", "p2p", "crest")])


@query("stream_alarm", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), """
med AS (SELECT series_id, quantile_cont(value, 0.6) AS threshold FROM p GROUP BY 1),
h AS (SELECT p.*, value > threshold AS hit FROM p JOIN med USING (series_id)),
i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY pos) AS island FROM h),
r AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, island ORDER BY pos) AS run FROM i),
d AS (SELECT series_id, pos, value AS m, 0.0e0 AS vr FROM p WHERE pos = 0
  UNION ALL SELECT p.series_id, p.pos, 0.2e0 * p.value + 0.8e0 * d.m, 0.2e0 * (p.value - (0.2e0 * p.value + 0.8e0 * d.m)) ** 2 + 0.8e0 * d.vr
  FROM d JOIN p ON p.series_id = d.series_id AND p.pos = d.pos + 1)""", tail=f"""
SELECT series_id, {sql_stamp('ts')} AS ts, {sql_r6('m')} AS ewma_mean, {sql_r6('m + 3.0e0 * (sqrt(vr) + 1e-12) * sqrt(0.2e0 / 1.8e0)')} AS dynamic_limit,
 run::BIGINT AS run, run >= 3 AS alarm FROM r JOIN d USING (series_id, pos)"""))
def stream_alarm(spark, sf):
    df, lay = v.readings(spark, sf)
    limits = quantile_table(df, lay, F.col("value"), {"threshold": 0.6})
    stream = event_stream(spark, sf).join(limits, "series_id").withColumnRenamed("value", "score")
    out = online.run_available(online.online_alarm(stream), "stream-alarm")
    stored = stored_events(spark, sf).join(limits, "series_id").withColumnRenamed("value", "score")
    rest = online.close_alarm(stored, out)
    return out.unionByName(rest).select("series_id", stamp("ts").alias("ts"), r6("ewma_mean").alias("ewma_mean"), r6("dynamic_limit").alias("dynamic_limit"), "run", "alarm")
