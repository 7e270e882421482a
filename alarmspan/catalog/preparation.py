"""Cleaning, resampling, scaling and splitting queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.functions.timeparse import hours_to_failure, parse_log_timestamp, timestamp_from_name
from alarmspan.operators import asof, clean, resample, scale, split
from alarmspan.operators.ordered import settle, with_position

CH = list(v.CHANNELS)
GAPS = (v.sql_panel(2), v.sql_pos("panel"))


def gap_panel(spark, sf):
    df, lay = v.panel(spark, sf, 2)
    return settle(with_position(df, lay), lay, "panel"), lay


def _cells(df, *lead):
    return df.select("series_id", stamp("ts").alias("ts"), *lead, *[r6(c).alias(c) for c in CH])


def _sql_cells(expr="{c}", lead=""):
    return f"series_id, {sql_stamp('ts')} AS ts, {lead}" + ", ".join(f"{sql_r6(expr.format(c=c))} AS {c}" for c in CH)


_W = "PARTITION BY series_id ORDER BY pos"
_FORWARD = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {c}" for c in CH)
_BACKWARD = ", ".join(f"first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS {c}" for c in CH)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in CH)


@query("fill_ffill", v.with_ctes(*GAPS, f"f AS (SELECT series_id, ts, pos, {_FORWARD} FROM p)",
                                 f"g AS (SELECT series_id, ts, {_BACKWARD} FROM f)",
                                 tail=f"SELECT {_sql_cells()} FROM g WHERE {_COMPLETE}"))
def fill_ffill(spark, sf):
    df, lay = gap_panel(spark, sf)
    return _cells(clean.fill_missing(df, lay, CH, "ffill", 5))


def _interp(c):
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pp IS NULL OR pos - {c}_pp > 5 THEN NULL
 WHEN {c}_nv IS NULL THEN {c}_pv ELSE {c}_pv + ({c}_nv - {c}_pv) * ((epoch_us(ts) - {c}_pt) / ({c}_nt - {c}_pt)::DOUBLE) END"""


_NEAR = ", ".join(
    f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS {c}_pp, "
    f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS {c}_pt, last_value({c} IGNORE NULLS) OVER b AS {c}_pv, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS {c}_nt, first_value({c} IGNORE NULLS) OVER a AS {c}_nv"
    for c in CH)


@query("fill_interpolate", v.with_ctes(*GAPS, f"""
nb AS (SELECT *, {_NEAR} FROM p WINDOW b AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 a AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT series_id, ts, {', '.join(f'{_interp(c)} AS {c}' for c in CH)} FROM nb)""",
    tail=f"SELECT {_sql_cells()} FROM ip WHERE {_COMPLETE}"))
def fill_interpolate(spark, sf):
    df, lay = gap_panel(spark, sf)
    return _cells(clean.fill_missing(df, lay, CH, "interpolate", 5))


@query("fill_drop", v.with_ctes(*GAPS, tail=f"SELECT {_sql_cells()} FROM p WHERE {_COMPLETE}"))
def fill_drop(spark, sf):
    df, lay = gap_panel(spark, sf)
    return _cells(clean.fill_missing(df, lay, CH, "drop"))


@query("fill_unlimited", v.with_ctes(*GAPS, "u AS (SELECT series_id, ts, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in CH)
    + " FROM p)", tail=f"SELECT {_sql_cells()} FROM u"))
def fill_unlimited(spark, sf):
    df, lay = gap_panel(spark, sf)
    return _cells(clean.fill_unlimited(df, lay, CH))


# The readings are coarse, so the mask is shown with a tolerance that some windows meet.
_STUCK_TOL = 4.0


@query("stuck_mask", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), tail=f"""
SELECT series_id, {sql_stamp('ts')} AS ts, coalesce(count(value) OVER w = 4 AND stddev_samp(value) OVER w < {_STUCK_TOL}, false) AS stuck
FROM p WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def stuck_mask(spark, sf):
    df, lay = v.readings(spark, sf)
    out = clean.stuck_mask(settle(with_position(df, lay), lay), lay, ["value"], 4, _STUCK_TOL)
    return out.select("series_id", stamp("ts").alias("ts"), F.col("stuck_value").alias("stuck"))


@query("clip_spikes", v.with_ctes(*GAPS, tail="SELECT " + _sql_cells(
    "CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, avg({c}) OVER w - 1.5e0 * stddev_samp({c}) OVER w), "
    "avg({c}) OVER w + 1.5e0 * stddev_samp({c}) OVER w) END") + " FROM p WINDOW w AS (PARTITION BY series_id)"))
def clip_spikes(spark, sf):
    df, lay = gap_panel(spark, sf)
    return _cells(clean.clip_spikes(df, lay, CH, 1.5))


@query("impute_mean", v.with_ctes(*GAPS, v.sql_split(), tail="SELECT " + _sql_cells(
    "coalesce({c}, avg({c}) OVER w)", "split, ") + " FROM s WINDOW w AS (PARTITION BY series_id, split)"))
def impute_mean(spark, sf):
    df, lay = gap_panel(spark, sf)
    tagged = split.temporal_split(df, 0.5, 0.1)
    return _cells(clean.impute_mean(tagged, lay, CH), "split")


@query("temporal_split", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), v.sql_split(train=0.6, cal=0.2),
    tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, pos, split, split_pos, split_n FROM s"))
def temporal_split(spark, sf):
    df, lay = v.readings(spark, sf)
    out = split.temporal_split(with_position(df, lay), 0.6, 0.2)
    return out.select("series_id", stamp("ts").alias("ts"), "pos", "split", "split_pos", "split_n")


@query("training_prefix", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), tail="""
SELECT series_id, count(*) FILTER (pos < floor(n * 0.6e0)) AS log_rows, count(*) FILTER (pos < greatest(50, floor(n * 0.4e0))) AS health_rows,
 count(*) FILTER (pos < greatest(2, floor(n * 0.5e0))) AS limit_rows,
 count(*) FILTER (ts <= t0 + INTERVAL 2 DAYS) AS baseline_rows
FROM (SELECT *, min(ts) OVER (PARTITION BY series_id) AS t0 FROM p) GROUP BY 1"""))
def training_prefix(spark, sf):
    df, lay = v.readings(spark, sf)
    rows = split.with_baseline_span(settle(with_position(df, lay), lay), lay)
    return rows.groupBy("series_id").agg(
        F.count_if(split.training_prefix(0.6)).alias("log_rows"), F.count_if(split.training_prefix(0.4, 50)).alias("health_rows"),
        F.count_if(split.training_prefix(0.5, 2)).alias("limit_rows"), F.count_if("in_baseline").alias("baseline_rows"))


_HTF = f"((epoch_us(ts) - epoch_us({v.SQL_FAIL})) / 3.6e9)"


@query("hours_to_failure", f"SELECT event_id, {sql_r6(_HTF)} AS hours FROM events")
def hours_to_failure_query(spark, sf):
    df = v.table(spark, sf, "events")
    htf = hours_to_failure(F.col("ts").cast("timestamp"), F.lit(v.FAILURE_TIME).cast("timestamp"))
    return df.select("event_id", r6(htf).alias("hours"))


@query("phase_label", f"""SELECT user_id AS series_id, CASE WHEN {_HTF} < -72 THEN 'Normal' WHEN {_HTF} < -24 THEN 'Degrading' ELSE 'Critical' END AS phase,
 count(*) AS n FROM events GROUP BY 1, 2""")
def phase_label(spark, sf):
    df, _ = v.readings(spark, sf)
    phase = clean.degradation_phase(hours_to_failure(F.col("ts"), F.col("failure_time")))
    return df.groupBy("series_id", phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query("severity_zone", """SELECT event_type AS channel, CASE WHEN value >= 18.0 THEN 'danger' WHEN value >= 11.2 THEN 'alarm'
 WHEN value >= 7.1 THEN 'alert' ELSE 'normal' END AS zone, count(*) AS n FROM events GROUP BY 1, 2""")
def severity_zone(spark, sf):
    df = v.table(spark, sf, "events")
    return df.groupBy(F.col("event_type").alias("channel"), clean.severity_zone(F.col("value")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("last_hours", f"""SELECT user_id AS series_id, count(*) AS n FROM events
 WHERE ts >= {v.SQL_FAIL} - INTERVAL 120 HOURS GROUP BY 1""")
def last_hours(spark, sf):
    df, lay = v.readings(spark, sf)
    return clean.last_hours(df, lay, 120).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def _sql_resample(minutes):
    us = int(minutes * 60_000_000)
    return f"""
o AS (SELECT *, epoch_us(date_trunc('day', min(ts) OVER (PARTITION BY series_id))) AS o FROM readings),
b AS (SELECT series_id, make_timestamp(o + (epoch_us(ts) - o) // {us} * {us}) AS bin, avg(value) AS value FROM o GROUP BY 1, 2)"""


@query("resample_uniform", v.with_ctes(v.SQL_READINGS, _sql_resample(50), tail=f"SELECT series_id, {sql_stamp('bin')} AS ts, {sql_r6('value')} AS value FROM b"))
def resample_uniform(spark, sf):
    df, lay = v.readings(spark, sf)
    out = resample.resample_mean(df, lay, ["value"], 50)
    return out.select("series_id", stamp("ts").alias("ts"), r6("value").alias("value"))


@query("decimate", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, value FROM p WHERE pos % 5 = 0"))
def decimate(spark, sf):
    df, lay = v.readings(spark, sf)
    return resample.decimate(with_position(df, lay), 5).select("series_id", stamp("ts").alias("ts"), "value")


_SPACING = ("gp AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY pos)) AS g FROM p)",
            "sp AS (SELECT series_id, quantile_cont(g / 6e7, 0.5) AS spacing_min FROM gp WHERE g IS NOT NULL GROUP BY 1)")


@query("median_spacing", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), *_SPACING, tail=f"SELECT series_id, {sql_r6('spacing_min')} AS spacing_min FROM sp"))
def median_spacing(spark, sf):
    df, lay = v.readings(spark, sf)
    out = resample.median_spacing(settle(with_position(df, lay), lay), lay)
    return out.select("series_id", r6("spacing_min").alias("spacing_min"))


@query("scale_robust", v.with_ctes(*GAPS, v.sql_split(), "q AS (SELECT series_id, " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.5) AS {c}2, quantile_cont({c}, 0.75) AS {c}3" for c in CH)
    + " FROM s WHERE split = 'train' GROUP BY 1)", tail="SELECT " + _sql_cells(
        "({c} - {c}2) / CASE WHEN {c}3 - {c}1 = 0 THEN 1 ELSE {c}3 - {c}1 END") + " FROM s JOIN q USING (series_id)"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


def _scaled(spark, sf, kind):
    df, lay = gap_panel(spark, sf)
    tagged = settle(split.temporal_split(df, 0.5, 0.1), lay)
    params = scale.fit_scaler(tagged, lay, CH, kind, F.col("split") == "train")
    return _cells(scale.apply_scaler(tagged, params, lay, CH))


@query("scale_standard", v.with_ctes(*GAPS, v.sql_split(), "q AS (SELECT series_id, " + ", ".join(
    f"avg({c}) AS {c}1, stddev_pop({c}) AS {c}2" for c in CH) + " FROM s WHERE split = 'train' GROUP BY 1)",
    tail="SELECT " + _sql_cells("({c} - {c}1) / CASE WHEN {c}2 = 0 THEN 1 ELSE {c}2 END") + " FROM s JOIN q USING (series_id)"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", v.with_ctes(*GAPS, v.sql_split(), "q AS (SELECT series_id, " + ", ".join(
    f"min({c}) AS {c}1, max({c}) AS {c}2" for c in CH) + " FROM s WHERE split = 'train' GROUP BY 1)",
    tail="SELECT " + _sql_cells("({c} - {c}1) / CASE WHEN {c}2 = {c}1 THEN 1 ELSE {c}2 - {c}1 END") + " FROM s JOIN q USING (series_id)"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("parse_timestamps", f"""SELECT event_id, {sql_stamp("CASE WHEN event_id % 7 IN (3, 4, 5) THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END")} AS ts,
 event_id % 7 = 6 AS bad FROM events WHERE event_id % 7 < 6
UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 7 = 6""")
def parse_timestamps(spark, sf):
    df = v.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    forms = ["dd-MM-yyyy'# 'HH:mm:ss", "yyyy-MM-dd'#'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm"]
    text = F.lit("sensor offline")
    for i, form in enumerate(forms):
        text = F.when(F.col("event_id") % 7 == i, F.date_format("ts", form)).otherwise(text)
    parsed = parse_log_timestamp(text)
    return df.select("event_id", stamp(parsed).alias("ts"), parsed.isNull().alias("bad"))


@query("name_timestamps", f"""SELECT event_id, {sql_stamp("CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts) ELSE TIMESTAMP '2003-10-22' + to_minutes(event_id) END")} AS ts
FROM events""")
def name_timestamps(spark, sf):
    df = v.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    name = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy.MM.dd.HH.mm.ss"))
             .when(F.col("event_id") % 3 == 1, F.unix_seconds("ts").cast("string"))
             .otherwise(F.concat(F.lit("snapshot_"), F.col("event_id"))))
    return df.select("event_id", stamp(timestamp_from_name(name, F.col("event_id"))).alias("ts"))


@query("log_union", f"""SELECT user_id AS series_id, {sql_stamp('ts')} AS ts, CASE WHEN ts < {v.SQL_FAIL} THEN value END AS value,
 CASE WHEN ts < {v.SQL_FAIL} THEN 'operating' ELSE 'post_shutdown' END AS phase FROM events""")
def log_union(spark, sf):
    df, _ = v.readings(spark, sf)
    before = df.where(F.col("ts") < F.col("failure_time")).select("series_id", "ts", "value")
    after = df.where(F.col("ts") >= F.col("failure_time")).select("series_id", "ts")
    return asof.union_logs(before, after).select("series_id", stamp("ts").alias("ts"), "value", "phase")


@query("log_gap", f"""SELECT {sql_r6(f"(epoch_us(min(ts) FILTER (ts >= {v.SQL_FAIL})) - epoch_us(max(ts) FILTER (ts < {v.SQL_FAIL}))) / 1e6")} AS gap_seconds FROM events""")
def log_gap(spark, sf):
    df, _ = v.readings(spark, sf)
    gap = asof.log_gap_seconds(df.where(F.col("ts") < F.col("failure_time")), df.where(F.col("ts") >= F.col("failure_time")))
    return gap.select(r6("gap_seconds").alias("gap_seconds"))
