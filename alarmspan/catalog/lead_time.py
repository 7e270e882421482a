"""Detection, thresholds, alarms and lead-time queries over the readings."""
from __future__ import annotations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.config import ThresholdConfig
from alarmspan.functions.timeparse import hours_between
from alarmspan.operators import alarms, metrics, thresholds
from alarmspan.operators.ordered import settle, with_position, with_totals
from alarmspan.operators.quantile import with_quantiles
from alarmspan.operators.split import normal_end_row
from alarmspan.plans import evaluate

BASE = (v.SQL_READINGS, v.sql_pos("readings"), v.sql_split())
SCORED = (*BASE, v.sql_scores())
KEYS = "series_id, method"
EVALUATED = (*SCORED, v.sql_test_rows(KEYS), v.sql_alarms(KEYS), v.sql_metrics(KEYS))
SQL_METRIC_COLUMNS = (f"series_id, method, {sql_r6('threshold')} AS threshold, {sql_stamp('fat')} AS fat, "
                      f"{sql_r6('vlt_hours')} AS vlt_hours, {sql_r6('far_pct')} AS far_pct, alarm_raised, valid_alarm")


def split_readings(spark, sf):
    df, lay = v.readings(spark, sf)
    return settle(evaluate.split_rows(with_position(df, lay)), lay, "readings"), lay


def scored(spark, sf, methods=("three_sigma", "ewma")):
    df, lay = split_readings(spark, sf)
    return evaluate.closed_form_scores(df, lay, ["value"], methods), lay.by("method")


def evaluated(spark, sf, methods=("three_sigma", "ewma")):
    rows, lay = scored(spark, sf, methods)
    return evaluate.evaluate_scores(rows, lay)


def _metric_columns(df):
    return df.select("series_id", "method", r6("threshold").alias("threshold"), stamp("fat").alias("fat"),
                     r6("vlt_hours").alias("vlt_hours"), r6("far_pct").alias("far_pct"), "alarm_raised", "valid_alarm")


@query("lead_time_three_sigma", v.with_ctes(
    *EVALUATED, tail=f"SELECT {SQL_METRIC_COLUMNS} FROM met WHERE method = 'three_sigma'"))
def lead_time_three_sigma(spark, sf):
    return _metric_columns(evaluated(spark, sf, ("three_sigma",)))


@query("method_comparison", v.with_ctes(
    *EVALUATED, tail=f"SELECT series_id, method, {sql_r6('threshold', 4)} AS threshold, {sql_stamp('fat')} AS fat, "
    f"{sql_r6('vlt_hours', 2)} AS vlt_hours, {sql_r6('far_pct', 2)} AS far_pct, alarm_raised, valid_alarm FROM met"))
def method_comparison(spark, sf):
    df = evaluated(spark, sf)
    return df.select("series_id", "method", r6("threshold", 4).alias("threshold"), stamp("fat").alias("fat"),
                     r6("vlt_hours", 2).alias("vlt_hours"), r6("far_pct", 2).alias("far_pct"), "alarm_raised", "valid_alarm")


@query("best_method", v.with_ctes(
    *EVALUATED, tail=f"SELECT series_id, method, {sql_r6('vlt_hours')} AS vlt_hours, {sql_r6('far_pct')} AS far_pct FROM met "
    "WHERE valid_alarm QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY vlt_hours DESC, method) = 1"))
def best_method(spark, sf):
    best = evaluate.best_method(evaluated(spark, sf))
    return best.select("series_id", "method", r6("vlt_hours").alias("vlt_hours"), r6("far_pct").alias("far_pct"))


@query("miss_rate", v.with_ctes(
    *EVALUATED, tail=f"SELECT method, {sql_r6('avg(CASE WHEN valid_alarm THEN 0.0e0 ELSE 1.0e0 END)')} AS miss_rate, "
    "count(*) AS n_series FROM met GROUP BY method"))
def miss_rate(spark, sf):
    return evaluated(spark, sf).groupBy("method").agg(
        r6(metrics.miss_rate(F.col("valid_alarm"))).alias("miss_rate"), F.count(F.lit(1)).alias("n_series"))


@query("method_status", v.with_ctes(
    *EVALUATED, tail=f"SELECT series_id, method, {sql_r6('vlt_hours')} AS vlt_hours, {sql_r6('far_pct')} AS far_pct, "
    "CASE WHEN valid_alarm THEN 'Valid' ELSE 'Missed' END AS status, far_pct < 10 AS far_ok FROM met"))
def method_status(spark, sf):
    df = evaluate.method_status(evaluated(spark, sf))
    return df.select("series_id", "method", r6("vlt_hours").alias("vlt_hours"), r6("far_pct").alias("far_pct"), "status", "far_ok")


@query("detection_delay", v.with_ctes(*EVALUATED, tail=f"""
SELECT series_id, method, {sql_stamp('fat')} AS fat,
  {sql_r6("CASE WHEN fat >= failure_time - INTERVAL 72 HOURS THEN (epoch_us(fat) - epoch_us(failure_time)) / 3.6e9 + 72 END")} AS delay_hours
FROM met"""))
def detection_delay(spark, sf):
    onset = F.col("failure_time") - F.expr("INTERVAL 72 HOURS")
    return evaluated(spark, sf).select("series_id", "method", stamp("fat").alias("fat"),
                                       r6(metrics.detection_delay_hours(F.col("fat"), onset)).alias("delay_hours"))


@query("vlt_normalised", v.with_ctes(*EVALUATED, tail=f"""
SELECT series_id, method, {sql_r6('avail')} AS available_lead_hours,
  {sql_r6('CASE WHEN avail > 0 THEN least(1.0e0, greatest(0.0e0, vlt_hours / avail)) END')} AS vlt_norm
FROM (SELECT *, (epoch_us(failure_time) - epoch_us(normal_end)) / 3.6e9 AS avail FROM met)"""))
def vlt_normalised(spark, sf):
    df = evaluated(spark, sf).withColumn("avail", hours_between(F.col("failure_time"), F.col("normal_end")))
    return df.select("series_id", "method", r6("avail").alias("available_lead_hours"),
                     r6(metrics.normalised_lead(F.col("vlt_hours"), F.col("avail"))).alias("vlt_norm"))


_SWEEP = ThresholdConfig().sweep_percentiles


@query("threshold_sweep", v.with_ctes(*SCORED, f"""
thr AS ({' UNION ALL '.join(
    f"SELECT series_id, method, {p}e0 AS percentile, quantile_cont(score, {p / 100}) AS threshold FROM sc WHERE split = 'train' GROUP BY 1, 2"
    for p in _SWEEP)}),
tst AS (SELECT *, max(CASE WHEN split_pos = least(floor(split_n * 0.05e0)::BIGINT, split_n - 1) THEN ts END)
  OVER (PARTITION BY series_id, method, percentile) AS normal_end FROM sc JOIN thr USING (series_id, method) WHERE split = 'test')""",
    v.sql_alarms("series_id, method, percentile"), v.sql_metrics("series_id, method, percentile", normal=False),
    tail=f"SELECT percentile, {SQL_METRIC_COLUMNS} FROM met"))
def threshold_sweep(spark, sf):
    rows, lay = scored(spark, sf)
    df = evaluate.threshold_sweep(rows, lay, _SWEEP)
    return df.select("percentile", "series_id", "method", r6("threshold").alias("threshold"), stamp("fat").alias("fat"),
                     r6("vlt_hours").alias("vlt_hours"), r6("far_pct").alias("far_pct"), "alarm_raised", "valid_alarm")


@query("ewma_scores", v.with_ctes(
    *SCORED, tail=f"SELECT series_id, split, {sql_stamp('ts')} AS ts, {sql_r6('score')} AS score FROM sc WHERE method = 'ewma'"))
def ewma_scores(spark, sf):
    rows, _ = scored(spark, sf, ("ewma",))
    return rows.select("series_id", "split", stamp("ts").alias("ts"), r6("score").alias("score"))


@query("score_normalised", v.with_ctes(*SCORED, tail=f"""
SELECT series_id, method, {sql_stamp('ts')} AS ts, {sql_r6('CASE WHEN hi - lo < 1e-12 THEN 0.0e0 ELSE (score - lo) / (hi - lo) END')} AS score
FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sc WINDOW w AS (PARTITION BY series_id, method))"""))
def score_normalised(spark, sf):
    from alarmspan.detectors.base import normalised
    rows, lay = scored(spark, sf)
    return normalised(rows, lay).select("series_id", "method", stamp("ts").alias("ts"), r6("score_norm").alias("score"))


@query("threshold_ewma", v.with_ctes(*SCORED, f"""
k AS (SELECT series_id, method, split_pos, score AS e FROM sc WHERE split = 'train' AND split_pos = 0
  UNION ALL SELECT c.series_id, c.method, c.split_pos, 0.2e0 * c.score + 0.8e0 * k.e FROM k JOIN sc c
  ON c.series_id = k.series_id AND c.method = k.method AND c.split = 'train' AND c.split_pos = k.split_pos + 1)""",
    tail=f"SELECT series_id, method, {sql_r6('avg(e) + 3.0e0 * (stddev_pop(e) + 1e-12) * sqrt(0.2e0 / 1.8e0)')} AS threshold FROM k GROUP BY 1, 2"))
def threshold_ewma(spark, sf):
    rows, lay = scored(spark, sf)
    rows = settle(rows, lay, "scores")
    train = rows.where("split = 'train'").withColumn("pos", F.col("split_pos"))
    limits = thresholds.compute_threshold(train, lay, "ewma")
    return limits.select("series_id", "method", r6("threshold").alias("threshold"))


# Likelihood on a dense grid, then halving on the sign of a difference quotient around its best point.
_SQL_EVT = v.with_ctes(v.SQL_MACHINE_LOG, """
q AS (SELECT series_id, quantile_cont(value, 0.95) AS u, quantile_cont(value, 0.99) AS p99 FROM readings GROUP BY 1),
tl AS (SELECT series_id, value - u AS x FROM readings JOIN q USING (series_id) WHERE value > u),
st AS (SELECT series_id, count(*) AS m, avg(x) AS mean, max(x) AS top FROM tl GROUP BY 1),
gr AS (
  SELECT series_id, k, CASE WHEN k < 400 THEN (pow(10e0, -3 * (400 - k) / 400.0e0) - 1) / top
    WHEN k < 600 THEN -pow(10e0, -1.8e0 - 4.2e0 * (k - 400) / 200.0e0) / top ELSE pow(10e0, -6 + 15 * (k - 600) / 1500.0e0) / mean END AS t
  FROM st, (SELECT unnest(generate_series(0, 2100)) AS k) WHERE m >= 10),
ll AS (SELECT series_id, k, t, avg(ln(1 + t * x)) AS xi FROM gr JOIN tl USING (series_id) GROUP BY ALL),
top AS (SELECT series_id, arg_max(k, -ln(xi / t) - xi) FILTER (xi > -1) AS k FROM ll GROUP BY 1),
bk AS (SELECT top.series_id, min(t) AS lo, max(t) AS hi FROM top JOIN gr ON gr.series_id = top.series_id AND abs(gr.k - top.k) <= 1 GROUP BY 1),
hv AS (
  SELECT series_id, 0 AS i, lo, hi FROM bk
  UNION ALL
  SELECT series_id, i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT series_id, i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT avg(ln(1 + (lo + hi) / 2 * x)) <= -1 OR 1 / ((lo + hi) / 2) - avg(x / (1 + (lo + hi) / 2 * x)) * (1 + 1 / avg(ln(1 + (lo + hi) / 2 * x))) > 0
       FROM tl WHERE tl.series_id = hv.series_id) AS up
    FROM hv WHERE i < 60)),
ft AS (SELECT series_id, (lo + hi) / 2 AS t, (SELECT avg(ln(1 + (lo + hi) / 2 * x)) FROM tl WHERE tl.series_id = hv.series_id) AS xi FROM hv WHERE i = 60)""",
    tail=f"""SELECT series_id, coalesce(m, 0) AS tail_rows,
 {sql_r6("CASE WHEN m >= 10 THEN u + (pow(0.01e0, -xi) - 1) / t ELSE p99 END", 3)} AS threshold
 FROM q LEFT JOIN st USING (series_id) LEFT JOIN ft USING (series_id)""")


@query("threshold_evt", _SQL_EVT)
def threshold_evt(spark, sf):
    df, lay = v.machine_log(spark, sf)
    limits = thresholds.compute_threshold(df.withColumn("score", F.col("value")), lay, "evt")
    return limits.select("series_id", "tail_rows", r6("threshold", 3).alias("threshold"))


@query("dynamic_threshold", v.with_ctes(*SCORED, f"""
d0 AS (SELECT series_id, method, pos, score, avg(score) FILTER (pos < 50) OVER (PARTITION BY series_id, method) AS mu0,
  stddev_pop(score) FILTER (pos < 50) OVER (PARTITION BY series_id, method) + 1e-12 AS sd0, ts FROM sc),
d AS (SELECT series_id, method, pos, mu0 AS m, sd0 * sd0 AS vr FROM d0 WHERE pos = 0
  UNION ALL SELECT d0.series_id, d0.method, d0.pos, 0.2e0 * d0.score + 0.8e0 * d.m,
   0.2e0 * (d0.score - (0.2e0 * d0.score + 0.8e0 * d.m)) ** 2 + 0.8e0 * d.vr
  FROM d JOIN d0 ON d0.series_id = d.series_id AND d0.method = d.method AND d0.pos = d.pos + 1)""", tail=f"""
SELECT series_id, method, {sql_stamp('ts')} AS ts, {sql_r6('m + 3.0e0 * (sqrt(vr) + 1e-12) * sqrt(0.2e0 / 1.8e0)')} AS threshold
FROM d JOIN d0 USING (series_id, method, pos)"""))
def dynamic_threshold(spark, sf):
    rows, lay = scored(spark, sf)
    out = thresholds.dynamic_threshold(settle(rows, lay, "scores"), lay)
    return out.select("series_id", "method", stamp("ts").alias("ts"), r6("threshold").alias("threshold"))


HITS = (v.SQL_READINGS, v.sql_pos("readings"), """
med AS (SELECT series_id, quantile_cont(value, 0.6) AS threshold FROM p GROUP BY 1),
tst AS (SELECT p.*, value AS score, pos AS split_pos, threshold FROM p JOIN med USING (series_id))""", v.sql_alarms("series_id", persistence="3"))


def _hits(spark, sf):
    df, lay = v.readings(spark, sf)
    rows = with_quantiles(settle(with_position(df, lay), lay), lay, F.col("value"), {"threshold": 0.6})
    return settle(rows.withColumn("score", F.col("value")), lay), lay


@query("alarm_runs", v.with_ctes(*HITS, tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, hit, alarm FROM al"))
def alarm_runs(spark, sf):
    rows, lay = _hits(spark, sf)
    out = alarms.alarm_signal(rows, lay, F.col("threshold"), 3)
    return out.select("series_id", stamp("ts").alias("ts"), (F.col("score") > F.col("threshold")).alias("hit"), "alarm")


@query("persistence_filter", v.with_ctes(
    *HITS[:3], v.sql_alarms("series_id", persistence="5"), tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, alarm FROM al"))
def persistence_filter(spark, sf):
    rows, lay = _hits(spark, sf)
    out = alarms.persistence_filter(rows, lay, F.col("score") > F.col("threshold"), 5)
    return out.select("series_id", stamp("ts").alias("ts"), "alarm")


@query("alarm_episodes", v.with_ctes(*HITS, """
g AS (SELECT *, sum(CASE WHEN alarm THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY pos) AS ep,
  lead(ts) OVER (PARTITION BY series_id ORDER BY pos) AS nxt, max(ts) OVER (PARTITION BY series_id) AS lst FROM al)""", tail=f"""
SELECT series_id, {sql_stamp('min(ts)')} AS start_ts, {sql_stamp('greatest(max(coalesce(nxt, lst)), max(ts))')} AS end_ts,
 count(*) AS steps, bool_or(nxt IS NULL) AS open_end
FROM g WHERE alarm GROUP BY series_id, ep"""))
def alarm_episodes(spark, sf):
    rows, lay = _hits(spark, sf)
    alarmed = settle(alarms.alarm_signal(rows, lay, F.col("threshold"), 3), lay)
    out = alarms.alarm_episodes(alarmed, lay)
    return out.select("series_id", stamp("start_ts").alias("start_ts"), stamp("end_ts").alias("end_ts"), "steps", "open_end")


@query("first_sustained", v.with_ctes(*HITS, """
f AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM al)""",
    tail=f"SELECT series_id, {sql_stamp('min(ts) FILTER (k = 5)')} AS first_alarm FROM f GROUP BY 1"))
def first_sustained(spark, sf):
    rows, lay = _hits(spark, sf)
    out = alarms.first_sustained(rows, lay, F.col("score") > F.col("threshold"), 5)
    return out.select("series_id", stamp("first_alarm").alias("first_alarm"))
