"""Asset-health, control-chart and correlation queries over the panel."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.operators import correlation, health
from alarmspan.operators.ordered import settle, with_position

CH = list(v.CHANNELS)


def placed_panel(spark, sf):
    df, lay = v.panel(spark, sf, 12)
    return settle(with_position(df, lay).withColumn("failure_time", F.lit(v.FAILURE_TIME).cast("timestamp")), lay, "panel"), lay


LONG = (v.sql_panel(12), v.sql_pos("panel"), "lg AS (" + " UNION ALL ".join(
    f"SELECT series_id, ts, pos, n, '{c}' AS channel, {c} AS value FROM p WHERE {c} IS NOT NULL" for c in CH) + ")", """
bl AS (SELECT series_id, channel, avg(value) AS mean, stddev_samp(value) + 1e-12 AS std
  FROM lg JOIN (SELECT series_id, min(ts) AS t0 FROM p GROUP BY 1) USING (series_id) WHERE ts <= t0 + INTERVAL 2 DAYS GROUP BY 1, 2)""", """
lz AS (SELECT *, mean + 3 * std AS ucl, (value - mean) / std AS z FROM lg JOIN bl USING (series_id, channel))""")


@query("baseline_limits", v.with_ctes(*LONG, tail=f"""SELECT series_id, channel, {sql_r6('mean')} AS mean, {sql_r6('std')} AS std,
 {sql_r6('mean + 3 * std')} AS ucl_3s, {sql_r6('greatest(0, mean - 3 * std)')} AS lcl_3s, {sql_r6('mean + 2 * std')} AS ucl_2s,
 {sql_r6('greatest(0, mean - 2 * std)')} AS lcl_2s FROM bl"""))
def baseline_limits(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.baseline_limits(df, lay, CH)
    return out.select("series_id", "channel", *[r6(c).alias(c) for c in ("mean", "std", "ucl_3s", "lcl_3s", "ucl_2s", "lcl_2s")])


# Daily statistics per machine stand in for snapshot columns; channel k is the k-th event type.
_SNAP = {f"{p}_ch{k}": e for k, c in enumerate(CH) for p, e in (
    ("rms", f"sqrt(avg({c} * {c}))"), ("p2p", f"max({c}) - min({c})"), ("var", f"var_pop({c})"))}


@query("channel_groups", v.with_ctes(v.sql_panel(2), f"""
sn AS (SELECT series_id, date_trunc('day', ts) AS ts, {', '.join(f'{e} AS {n}' for n, e in _SNAP.items())} FROM panel GROUP BY 1, 2),
sl AS ({' UNION ALL '.join(f"SELECT series_id, ts, '{g}' AS grp, 'ch{k}' AS channel, {p}_ch{k} AS value FROM sn" for g, p in (('rms', 'rms'), ('peak_to_peak', 'p2p'), ('variance', 'var')) for k in range(len(CH)))})""",
    tail=f"""SELECT series_id, grp AS "group", channel, 'b' || (CAST(substr(channel, 3) AS INT) // 2 + 1) || CASE WHEN CAST(substr(channel, 3) AS INT) % 2 = 0 THEN 'x' ELSE 'y' END AS label,
 count(value) AS n, {sql_r6('max(value)')} AS peak FROM sl WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def channel_groups(spark, sf):
    df, lay = v.panel(spark, sf, 2)
    day = df.withColumn("ts", F.date_trunc("day", "ts"))
    stats = {f"{p}_ch{k}": e for k, c in enumerate(CH) for p, e in (
        ("rms", F.sqrt(F.avg(F.col(c) * F.col(c)))), ("p2p", F.max(c) - F.min(c)), ("var", F.var_pop(c)))}
    snap = day.groupBy("series_id", "ts").agg(*[e.alias(n) for n, e in stats.items()])
    long = health.grouped_long(snap, lay, list(stats))
    return long.groupBy("series_id", "group", "channel", health.bearing_label(F.col("channel")).alias("label")).agg(
        F.count("value").alias("n"), r6(F.max("value")).alias("peak"))


@query("spc_limits", v.with_ctes(*LONG, tail=f"""SELECT series_id, channel, {sql_r6('avg(value)')} AS center,
 {sql_r6('avg(value) + 3 * (stddev_samp(value) + 1e-12)')} AS ucl, {sql_r6('avg(value) - 3 * (stddev_samp(value) + 1e-12)')} AS lcl
FROM lg WHERE pos < greatest(2, floor(n * 0.5e0)) GROUP BY 1, 2"""))
def spc_limits(spark, sf):
    df, lay = placed_panel(spark, sf)
    return health.spc_limits(df, lay, CH).select("series_id", "channel", *[r6(c).alias(c) for c in ("center", "ucl", "lcl")])


@query("ucl_rate", v.with_ctes(*LONG, tail=f"""SELECT p.series_id, {sql_stamp('p.ts')} AS ts,
 {sql_r6('count(*) FILTER (value > ucl) / 5.0e0')} AS ucl_rate FROM p LEFT JOIN lz ON p.series_id = lz.series_id AND p.ts = lz.ts GROUP BY p.series_id, p.ts"""))
def ucl_rate(spark, sf):
    df, lay = placed_panel(spark, sf)
    rows = health.with_limits(df, health.baseline_limits(df, lay, CH), lay, CH)
    return rows.select("series_id", stamp("ts").alias("ts"), r6(health.violation_rate(rows, CH)).alias("ucl_rate"))


@query("dri", v.with_ctes(*LONG, "zr AS (SELECT series_id, ts, pos, avg(z) AS raw FROM lz GROUP BY 1, 2, 3)", """
dr AS (SELECT *, avg(raw) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS dri FROM zr)""",
    tail=f"""SELECT series_id, {sql_stamp('ts')} AS ts, {sql_r6('raw')} AS dri_raw, {sql_r6('dri')} AS dri,
 CASE WHEN dri >= 4 THEN 'critical' WHEN dri >= 2 THEN 'attention' ELSE 'normal' END AS band FROM dr"""))
def dri(spark, sf):
    df, lay = placed_panel(spark, sf)
    rows = settle(health.with_limits(df, health.baseline_limits(df, lay, CH), lay, CH), lay, "limits")
    out = health.deterioration_index(rows, lay, CH, 12)
    return out.select("series_id", stamp("ts").alias("ts"), r6("dri_raw").alias("dri_raw"), r6("dri").alias("dri"), "band")


@query("fault_sequence", v.with_ctes(*LONG, tail=f"""SELECT series_id, channel, {sql_stamp('first')} AS first, {sql_r6('peak')} AS peak, {sql_r6('ucl')} AS ucl,
 row_number() OVER (PARTITION BY series_id ORDER BY first, channel) AS rank
FROM (SELECT series_id, channel, min(ts) FILTER (value > ucl) AS first, max(value) AS peak, max(ucl) AS ucl FROM lz GROUP BY 1, 2) WHERE first IS NOT NULL"""))
def fault_sequence(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.fault_sequence(df, health.baseline_limits(df, lay, CH), lay, CH)
    return out.select("series_id", "channel", stamp("first").alias("first"), r6("peak").alias("peak"), r6("ucl").alias("ucl"),
                      F.col("rank").cast("long").alias("rank"))


_CONTRIB = """
ct AS (SELECT series_id, channel, max(value) AS peak, any_value(mean) AS mean, greatest(0.0e0, max(value) - any_value(mean)) AS dev FROM lz GROUP BY 1, 2),
cp AS (SELECT *, CASE WHEN sum(dev) OVER (PARTITION BY series_id) > 0 THEN dev / sum(dev) OVER (PARTITION BY series_id) * 100 ELSE 0 END AS pct,
  row_number() OVER (PARTITION BY series_id ORDER BY dev DESC, channel) AS rank FROM ct)"""


@query("contributions", v.with_ctes(*LONG, _CONTRIB, tail=f"""SELECT series_id, channel, {sql_r6('peak')} AS peak, {sql_r6('mean')} AS mean, {sql_r6('dev')} AS dev,
 {sql_r6('pct')} AS pct, rank FROM cp"""))
def contributions(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.contributions(df, health.baseline_limits(df, lay, CH), lay, CH)
    return out.select("series_id", "channel", *[r6(c).alias(c) for c in ("peak", "mean", "dev", "pct")], F.col("rank").cast("long").alias("rank"))


_BEHAVIOUR = """
bp AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY series_id, channel) AS m, value - lag(value) OVER w AS step FROM lz
  WINDOW w AS (PARTITION BY series_id, channel ORDER BY ts)),
bs AS (SELECT series_id, channel, max(z) AS z_max, CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(z, k) END AS slope, coalesce(stddev_pop(step), 0) AS spread,
  avg(z) FILTER (k >= m - ceil(m / 4)) AS recent, any_value(std) AS std FROM bp GROUP BY 1, 2),
bh AS (SELECT *, CASE WHEN z_max < 1.5 THEN 'Normal' WHEN slope > 0.0005 AND recent > 1 THEN 'Gradual Drift'
  WHEN spread > std * 0.5 AND z_max > 3 THEN 'Oscillatory' WHEN z_max > 5 AND recent < 2 THEN 'Sudden Spike' ELSE 'Sustained High' END AS behaviour FROM bs)"""


@query("behaviour", v.with_ctes(*LONG, _BEHAVIOUR, tail=f"""SELECT series_id, channel, {sql_r6('z_max')} AS z_max, {sql_r6('slope')} AS slope,
 {sql_r6('spread')} AS spread, {sql_r6('recent')} AS recent, behaviour FROM bh"""))
def behaviour(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.behaviour(df, health.baseline_limits(df, lay, CH), lay, CH)
    return out.select("series_id", "channel", *[r6(c).alias(c) for c in ("z_max", "slope", "spread", "recent")], "behaviour")


def _evolution_sql():
    parts = []
    for label, h in health.EVOLUTION_HOURS.items():
        gap = f"abs(epoch_us(ts) - (epoch_us({v.SQL_FAIL}) - {h * 3_600_000_000}))"
        for c in CH:
            parts.append(f"SELECT series_id, '{label}' AS \"window\", '{c}' AS channel, CASE WHEN count(*) FILTER ({gap} <= 300000000) > 0 "
                         f"THEN avg({c}) FILTER ({gap} <= 300000000) ELSE arg_min_null({c}, {gap} * 2 + CASE WHEN epoch_us(ts) > epoch_us({v.SQL_FAIL}) - {h * 3_600_000_000} THEN 1 ELSE 0 END) END AS value FROM p GROUP BY 1")
    return v.with_ctes(*LONG, "ev AS (" + " UNION ALL ".join(parts) + ")", tail=f"""
SELECT series_id, "window", channel, {sql_r6('value')} AS value, {sql_r6('(value - mean) / std', 2)} AS deviation FROM ev JOIN bl USING (series_id, channel)""")


@query("evolution", _evolution_sql())
def evolution(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.evolution(df, health.baseline_limits(df, lay, CH), lay, CH)
    return out.select("series_id", "window", "channel", r6("value").alias("value"), r6("deviation", 2).alias("deviation"))


@query("peak_table", v.with_ctes(*LONG, tail=f"""SELECT series_id, channel, {sql_r6('max(value)')} AS peak, {sql_stamp('min(ts) FILTER (value = mx)')} AS peak_ts,
 {sql_r6('any_value(ucl)')} AS ucl, coalesce(max(value) > any_value(ucl), false) AS exceeded
FROM (SELECT *, max(value) OVER (PARTITION BY series_id, channel) AS mx FROM lz) GROUP BY 1, 2"""))
def peak_table(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.peak_table(df, health.baseline_limits(df, lay, CH), lay, CH)
    return out.select("series_id", "channel", r6("peak").alias("peak"), stamp("peak_ts").alias("peak_ts"), r6("ucl").alias("ucl"), "exceeded")


@query("channels_in_alarm", v.with_ctes(*LONG, tail="""SELECT series_id, count(*) FILTER (hit) AS n_channels_alarm
FROM (SELECT series_id, channel, max(value) > any_value(ucl) AS hit FROM lz GROUP BY 1, 2) GROUP BY 1"""))
def channels_in_alarm(spark, sf):
    df, lay = placed_panel(spark, sf)
    return health.channels_in_alarm(health.peak_table(df, health.baseline_limits(df, lay, CH), lay, CH), lay)


@query("rolling_trend", v.with_ctes(v.SQL_READINGS, v.sql_pos("readings"), tail=f"""SELECT series_id, {sql_stamp('ts')} AS ts,
 {sql_r6('avg(value) OVER a')} AS trend, {sql_r6('CASE WHEN count(value) OVER b = 18 THEN avg(value) OVER b END')} AS full_trend
FROM p WINDOW a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 35 PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)"""))
def rolling_trend(spark, sf):
    df, lay = v.readings(spark, sf)
    out = health.rolling_trend(settle(with_position(df, lay), lay), lay, "value", 36)
    out = health.rolling_trend(settle(out, lay), lay, "value", 18, full_only=True, out="full_trend")
    return out.select("series_id", stamp("ts").alias("ts"), r6("trend").alias("trend"), r6("full_trend").alias("full_trend"))


@query("kpi", v.with_ctes(*LONG, f"""
kc AS (SELECT series_id, count(*) FILTER (hit) AS k, max(peak) AS peak FROM (SELECT series_id, channel, max(value) AS peak, max(value) > any_value(ucl) AS hit FROM lz GROUP BY 1, 2) GROUP BY 1),
kl AS (SELECT series_id, count(*) AS n_rows, {', '.join(f'arg_max({c}, ts) FILTER ({c} IS NOT NULL) AS last_{c}' for c in CH)} FROM p GROUP BY 1)""",
    tail=f"SELECT series_id, n_rows, {sql_r6('peak')} AS peak, k AS channels_in_alarm, {', '.join(f'{sql_r6(f'last_{c}')} AS last_{c}' for c in CH)} FROM kl JOIN kc USING (series_id)"))
def kpi(spark, sf):
    df, lay = placed_panel(spark, sf)
    out = health.key_figures(df, health.baseline_limits(df, lay, CH), lay, CH)
    return out.select("series_id", "n_rows", r6("peak").alias("peak"), "channels_in_alarm", *[r6(f"last_{c}").alias(f"last_{c}") for c in CH])


# ---- correlation ----
PAIRS = (v.sql_panel(12), "pr AS (" + " UNION ALL ".join(
    f"SELECT series_id, ts, '{a}' AS chan_a, '{b}' AS chan_b, {a} AS a, {b} AS b FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in combinations(CH, 2)) + ")")
PK = "series_id, chan_a, chan_b"


def pairs(spark, sf):
    df, lay = v.panel(spark, sf, 12)
    return correlation.channel_pairs(df, lay, CH), correlation.pair_layout(lay)


_CORR = f"""
co AS (SELECT {PK}, count(*) AS n, corr(a, b) AS r, regr_slope(b, a) AS slope, regr_intercept(b, a) AS intercept FROM pr GROUP BY {PK} HAVING count(*) >= 5)"""


@query("pair_correlation", v.with_ctes(*PAIRS, _CORR, tail=f"""SELECT {PK}, n, {sql_r6('r')} AS r,
 CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
 CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM co"""))
def pair_correlation(spark, sf):
    rows, lay = pairs(spark, sf)
    return correlation.pair_correlation(rows, lay).select(*lay.keys, "n", r6("r").alias("r"), "strength", "direction")


@query("ols_fit", v.with_ctes(*PAIRS, _CORR, tail=f"SELECT {PK}, {sql_r6('slope')} AS slope, {sql_r6('intercept')} AS intercept FROM co"))
def ols_fit(spark, sf):
    rows, lay = pairs(spark, sf)
    return correlation.pair_correlation(rows, lay).select(*lay.keys, r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("pair_p_values")
def pair_p_values(spark, sf):
    rows, lay = pairs(spark, sf)
    return correlation.with_p_value(correlation.pair_correlation(rows, lay)).select(*lay.keys, "n", "r", "p_value")


_CCF = v.sql_pos("pr", "pp", PK) + f""",
lc AS (SELECT y.series_id, y.chan_a, y.chan_b, k AS lag, coalesce(CASE WHEN isnan(corr(x.a, y.b)) THEN 0 ELSE corr(x.a, y.b) END, 0) AS r, any_value(y.n) AS n
  FROM pp y CROSS JOIN (SELECT unnest(generate_series(-20, 20)) AS k) g LEFT JOIN pp x
  ON x.series_id = y.series_id AND x.chan_a = y.chan_a AND x.chan_b = y.chan_b AND x.pos = y.pos + k GROUP BY 1, 2, 3, 4)"""


@query("lagged_ccf", v.with_ctes(*PAIRS, _CCF, tail=f"SELECT {PK}, lag, {sql_r6('r')} AS r, {sql_r6('1.96 / sqrt(n)')} AS bound FROM lc"))
def lagged_ccf(spark, sf):
    rows, lay = pairs(spark, sf)
    out = correlation.lagged_correlation(rows, lay, 20)
    return out.select(*lay.keys, F.col("lag").cast("long").alias("lag"), r6("r").alias("r"), r6("bound").alias("bound"))


@query("lead_lag", v.with_ctes(*PAIRS, _CCF, tail=f"""SELECT {PK}, lag AS best_lag, {sql_r6('r')} AS best_r,
 CASE WHEN lag = 0 THEN 'simultaneous' WHEN lag > 0 THEN chan_b ELSE chan_a END AS leader FROM lc
 QUALIFY row_number() OVER (PARTITION BY {PK} ORDER BY round(abs(r), 12) DESC, lag) = 1"""))
def lead_lag(spark, sf):
    rows, lay = pairs(spark, sf)
    out = correlation.lead_lag(correlation.lagged_correlation(rows, lay, 20), lay)
    return out.select(*lay.keys, F.col("best_lag").cast("long").alias("best_lag"), r6("best_r").alias("best_r"), "leader")


@query("rolling_corr", v.with_ctes(*PAIRS, v.sql_pos("pr", "pp", PK), tail=f"""SELECT {PK}, {sql_stamp('ts')} AS ts,
 {sql_r6('CASE WHEN count(*) OVER w > 1 THEN covar_pop(a, b) OVER w / nullif(stddev_pop(a) OVER w * stddev_pop(b) OVER w, 0) END')} AS rolling_r
FROM pp WINDOW w AS (PARTITION BY {PK} ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def rolling_corr(spark, sf):
    rows, lay = pairs(spark, sf)
    return correlation.rolling_correlation(rows, lay, 12).select(*lay.keys, stamp("ts").alias("ts"), r6("rolling_r").alias("rolling_r"))


@query("overlay", v.with_ctes(*PAIRS, v.sql_pos("pr", "pp", PK), tail=f"""SELECT {PK}, {sql_stamp('ts')} AS ts,
 {sql_r6('(a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-12)')} AS za, {sql_r6('(b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-12)')} AS zb,
 {sql_r6('CASE WHEN n > 1 THEN pos / (n - 1)::DOUBLE ELSE 0 END')} AS progress FROM pp WINDOW w AS (PARTITION BY {PK})"""))
def overlay(spark, sf):
    rows, lay = pairs(spark, sf)
    return correlation.overlay(rows, lay).select(*lay.keys, stamp("ts").alias("ts"), r6("za").alias("za"), r6("zb").alias("zb"), r6("progress").alias("progress"))


@query("influence_summary", v.with_ctes(*PAIRS, _CORR, _CCF, f"""
bl AS (SELECT {PK}, lag AS best_lag, r AS best_r, CASE WHEN lag = 0 THEN 'simultaneous' WHEN lag > 0 THEN chan_b ELSE chan_a END AS leader FROM lc
 QUALIFY row_number() OVER (PARTITION BY {PK} ORDER BY round(abs(r), 12) DESC, lag) = 1),
fa AS (SELECT {PK}, r, leader, abs(best_lag)::BIGINT AS lag_rows, best_r, coalesce(abs(best_r) > 0.5, false) AS influence,
 CASE WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END AS grade
 FROM co JOIN bl USING ({PK}))""", tail=f"""SELECT {PK}, {sql_r6('r')} AS r, grade, leader, lag_rows, {sql_r6('best_r')} AS best_r, influence,
 chan_a || '/' || chan_b || ': ' || grade || CASE WHEN lag_rows = 0 THEN ', no lag' ELSE ', ' || leader || ' ahead by ' || lag_rows END
  || CASE WHEN influence THEN ', linked' ELSE '' END AS note FROM fa"""))
def influence_summary(spark, sf):
    rows, lay = pairs(spark, sf)
    best = correlation.lead_lag(correlation.lagged_correlation(rows, lay, 20), lay)
    out = correlation.influence_summary(correlation.pair_correlation(rows, lay), best, lay)
    return out.select(*lay.keys, r6("r").alias("r"), "grade", "leader", "lag_rows", r6("best_r").alias("best_r"), "influence", "note")
