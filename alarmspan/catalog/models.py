"""Uncertainty over the readings, model detectors over the embedding matrix and the panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.lead_time import BASE, SCORED, scored, split_readings
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.config import SplitConfig
from alarmspan.detectors import forest, pca, rff
from alarmspan.operators import health, uncertainty
from alarmspan.operators.ordered import settle, with_position
from alarmspan.operators.split import normal_rows
from alarmspan.plans import evaluate

_PV = """
ts3 AS (SELECT * FROM sc WHERE method = 'three_sigma'),
pv AS (SELECT t.series_id, t.ts, t.split_pos, t.split_n, t.score,
  (SELECT count(*) FROM ts3 c WHERE c.series_id = t.series_id AND c.split = 'cal' AND c.score >= t.score)
   / ((SELECT count(*) FROM ts3 c WHERE c.series_id = t.series_id AND c.split = 'cal') + 1)::DOUBLE AS p_value
  FROM ts3 t WHERE t.split = 'test')"""


def _pvalues(spark, sf):
    rows, lay = scored(spark, sf, ("three_sigma",))
    return uncertainty.conformal_pvalues(rows, lay), lay


@query("conformal_pvalues", v.with_ctes(*SCORED, _PV, tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, {sql_r6('p_value')} AS p_value FROM pv"))
def conformal_pvalues(spark, sf):
    out, _ = _pvalues(spark, sf)
    return out.select("series_id", stamp("ts").alias("ts"), r6("p_value").alias("p_value"))


@query("conformal_alarm", v.with_ctes(*SCORED, _PV, "tst AS (SELECT *, -p_value AS sv, -0.3e0 AS threshold FROM pv)",
    v.sql_alarms("series_id", source="(SELECT * EXCLUDE (score), sv AS score FROM tst)", persistence="3"),
    tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, alarm FROM al"))
def conformal_alarm(spark, sf):
    out, lay = _pvalues(spark, sf)
    return uncertainty.conformal_alarm(out, lay, 0.3, 3).select("series_id", stamp("ts").alias("ts"), "alarm")


_ALPHAS = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20)


@query("calibration_table", v.with_ctes(*SCORED, _PV, tail=f"""SELECT alpha, {sql_r6('avg(CASE WHEN p_value < alpha THEN 1.0e0 ELSE 0.0e0 END)')} AS actual_far, count(*) AS n_rows
FROM (SELECT * FROM pv WHERE split_pos <= least(floor(split_n * 0.05e0)::BIGINT, split_n - 1)) pv, (VALUES {', '.join(f'({a}e0)' for a in _ALPHAS)}) g(alpha) GROUP BY 1"""))
def calibration_table(spark, sf):
    out, _ = _pvalues(spark, sf)
    out = out.where(normal_rows(SplitConfig().normal_period_fraction))
    return uncertainty.calibration_table(out, _ALPHAS).select("alpha", r6("actual_far").alias("actual_far"), "n_rows")


_B = 30


@query("bootstrap_interval", v.with_ctes(*BASE, f"""
tr AS (SELECT series_id, split_pos, split_n, abs(value) AS h FROM s WHERE split = 'train'),
d1 AS (SELECT series_id, split_n, b, (b * 7919777 + split_pos * 104729 + 43) % 2147483647 AS x FROM tr, (SELECT unnest(generate_series(0, {_B - 1})) AS b)),
d2 AS (SELECT series_id, split_n, b, ((x * x) % 2147483647 * 48271 + x * 69621) % 2147483647 AS x FROM d1),
d3 AS (SELECT series_id, b, (((x * x) % 2147483647 * 16807 + x) % 2147483647) % split_n AS split_pos FROM d2),
bm AS (SELECT series_id, b, avg(h) AS mu, stddev_pop(h) + 1e-12 AS sd FROM d3 JOIN tr USING (series_id, split_pos) GROUP BY 1, 2),
bs AS (SELECT s.series_id, s.ts, abs((abs(value) - mu) / sd) AS score FROM s JOIN bm USING (series_id))""",
    tail=f"""SELECT series_id, {sql_stamp('ts')} AS ts, {sql_r6('avg(score)', 4)} AS mean_score, {sql_r6('quantile_cont(score, 0.05)', 4)} AS lower,
 {sql_r6('quantile_cont(score, 0.95)', 4)} AS upper FROM bs GROUP BY 1, 2"""))
def bootstrap_interval(spark, sf):
    df, lay = split_readings(spark, sf)
    out = uncertainty.weighted_moments_interval(df, lay, F.abs("value"), _B)
    return out.select("series_id", stamp("ts").alias("ts"), *[r6(c, 4).alias(c) for c in ("mean_score", "lower", "upper")])


def split_matrix(spark, sf, one_series=False):
    df, lay = v.matrix(spark, sf, one_series)
    return settle(evaluate.split_rows(with_position(df, lay)), lay, "matrix"), lay


def _scored(detector, spark, sf, one_series=False):
    df, lay = split_matrix(spark, sf, one_series)
    return detector.score_splits(df, lay).select("series_id", stamp("ts").alias("ts"), "split", "method", "score")


@query("hotelling_t2")
def hotelling_t2(spark, sf):
    return _scored(pca.hotelling_t2(), spark, sf)


@query("t2_limits")
def t2_limits(spark, sf):
    df, lay = split_matrix(spark, sf)
    params = pca.hotelling_t2().fit(df.where("split = 'train'").withColumn("pos", F.col("split_pos")), lay)
    return pca.t2_limit(params).select("series_id", "n_train", "k", "limit")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return _scored(forest.isolation_forest(), spark, sf)


@query("one_class_rff")
def one_class_rff(spark, sf):
    return _scored(rff.one_class_svm(), spark, sf)


@query("sequence_error")
def sequence_error(spark, sf):
    return _scored(pca.sequence_ae(), spark, sf, one_series=True)


@query("forest_attribution")
def forest_attribution(spark, sf):
    df, lay = split_matrix(spark, sf)
    trees = forest.isolation_forest().fit(df.where("split = 'train'").withColumn("pos", F.col("split_pos")), lay)
    out = forest.forest_attribution(df.where("split = 'test'"), trees, lay)
    return forest.top_contributions(out, lay, top=15).select("series_id", stamp("ts").alias("ts"), "rank", "feature", "contribution")


@query("bootstrap_forest")
def bootstrap_forest(spark, sf):
    df, lay = split_matrix(spark, sf)
    det = forest.isolation_forest(n_estimators=20)
    params = uncertainty.bootstrap_fit(det, df.where("split = 'train'"), lay, 5)
    rows = df.where("split = 'test'").withColumn("pos", F.col("split_pos"))
    out = uncertainty.bootstrap_interval(uncertainty.bootstrap_scores(det, params, rows, lay, 5), lay)
    return out.select("series_id", stamp("ts").alias("ts"), "mean_score", "lower", "upper")


@query("model_comparison")
def model_comparison(spark, sf):
    from alarmspan.config import ModelConfig
    from alarmspan.detectors.base import build_detectors
    df, lay = split_matrix(spark, sf)
    df = df.withColumn("failure_time", F.timestamp_seconds(F.lit(1_704_067_200 + 10_000_000)))
    cfg = ModelConfig()
    scores = evaluate.model_scores(df, lay, build_detectors(cfg.methods, "features", cfg.params, strict=True), strict=True)
    out = evaluate.summary(evaluate.evaluate_scores(scores, lay.by("method")))
    return out.select("series_id", "method", "threshold", stamp("fat").alias("fat"), "vlt_hours", "far_pct", "valid_alarm")


@query("health_alert")
def health_alert(spark, sf):
    """Forest health score of the panel, its 95th percentile, first sustained alert and lead to shutdown."""
    df, lay = v.panel(spark, sf, 12)
    return health.health_alert(df, lay, list(v.CHANNELS)).select(
        "series_id", "threshold", stamp("first_alarm").alias("first_alarm"), "lead_hours")



@query("event_summary")
def event_summary(spark, sf):
    df, lay = v.panel(spark, sf, 12)
    channels = list(v.CHANNELS)
    placed = settle(with_position(df, lay), lay, "panel")
    limits = health.baseline_limits(placed, lay, channels)
    return health.event_summary(
        health.contributions(placed, limits, lay, channels), health.behaviour(placed, limits, lay, channels),
        health.fault_sequence(placed, limits, lay, channels), health.health_alert(df, lay, channels), lay)
