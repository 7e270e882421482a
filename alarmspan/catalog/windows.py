"""Feature-extraction, as-of and rate-sweep queries."""
from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.config import ExperimentConfig, ModelConfig, SamplingConfig
from alarmspan.functions.timeparse import hours_to_failure
from alarmspan.detectors.base import build_detectors
from alarmspan.operators import asof, clean, features, uncertainty
from alarmspan.operators.ordered import settle, with_position
from alarmspan.plans import evaluate, pipeline, sweeps
from alarmspan.session import cut_lineage

CH = list(v.CHANNELS)
PREFIXES = ("rms", "kurt", "skew", "crest", "p2p", "shape", "var", "mabs")
ALL8 = (*features.ALL_FEATURES, "mean_abs")


def sql_windows(source: str, size: int, step: int, name: str = "wd") -> str:
    return (f"{name} AS (SELECT *, unnest(generate_series(greatest(0, ceil((pos - {size} + 1) / {step}.0e0)::BIGINT), "
            f"least(pos // {step}, (n - {size}) // {step}))) AS w FROM {source} WHERE n >= {size})")


def sql_centred(cols, source: str = "wd", name: str = "wc", keys: str = "series_id, w") -> str:
    return f"{name} AS (SELECT *, " + ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY {keys}) AS {c}_d" for c in cols) + f" FROM {source})"


def sql_stats(c: str, suffix: str, prefixes=PREFIXES) -> dict[str, str]:
    d = f"{c}_d"
    sd = f"sqrt(avg({d} * {d}))"
    rms = f"sqrt(avg({c} * {c}))"
    made = {"rms": rms, "kurt": f"CASE WHEN max({c}) = min({c}) THEN -3 ELSE avg({d} ** 4) / ({sd} + 1e-12) ** 4 - 3 END",
            "skew": f"CASE WHEN max({c}) = min({c}) THEN 0 ELSE avg({d} ** 3) / ({sd} + 1e-12) ** 3 END",
            "crest": f"max(abs({c})) / ({rms} + 1e-12)", "p2p": f"max({c}) - min({c})",
            "shape": f"({rms} + 1e-12) / (avg(abs({c})) + 1e-12)", "var": f"avg({d} * {d})", "mabs": f"avg(abs({c}))"}
    return {f"{p}_{suffix}": made[p] for p in prefixes}


READ = (v.SQL_READINGS, v.sql_pos("readings"))


def _positioned(spark, sf):
    df, lay = v.readings(spark, sf)
    return settle(with_position(df, lay), lay, "readings"), lay


_F1 = sql_stats("value", "value")


@query("window_features", v.with_ctes(*READ, sql_windows("p", 10, 5), sql_centred(["value"]), tail=f"""
SELECT series_id, w, {sql_stamp('max(ts) FILTER (pos = w * 5 + 5)')} AS center_ts,
 {sql_r6(f"max((epoch_us(ts) - epoch_us({v.SQL_FAIL})) / 3.6e9) FILTER (pos = w * 5 + 5)")} AS hours_to_failure,
 {', '.join(f'{sql_r6(e)} AS {n}' for n, e in _F1.items())} FROM wc GROUP BY 1, 2"""))
def window_features(spark, sf):
    df, lay = _positioned(spark, sf)
    df = df.withColumn("hours_to_failure", hours_to_failure(F.col("ts"), F.col("failure_time")))
    out = features.rolling_features(df, lay, ["value"], 10, 0.5, ALL8)
    return out.select("series_id", "w", stamp("ts").alias("center_ts"), r6("hours_to_failure").alias("hours_to_failure"),
                      *[r6(c).alias(c) for c in _F1])


FILLED = (v.sql_panel(2), v.sql_pos("panel", "pp"), "p AS (SELECT series_id, ts, pos, n, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a) AS {c}" for c in CH)
    + " FROM pp WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


def filled_panel(spark, sf):
    df, lay = v.panel(spark, sf, 2)
    return settle(clean.fill_unlimited(with_position(df, lay), lay, CH), lay, "panel"), lay


_CROSS = {f"corr_{a}_{b}": f"coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0)" for a, b in combinations(CH, 2)}
_CROSS["cov_trace"] = " + ".join(f"var_samp({c})" for c in CH)


@query("window_cross_channel", v.with_ctes(*FILLED, sql_windows("p", 10, 5), tail=f"""
SELECT series_id, w, {', '.join(f'{sql_r6(e)} AS {n}' for n, e in _CROSS.items())} FROM wd GROUP BY 1, 2"""))
def window_cross_channel(spark, sf):
    df, lay = filled_panel(spark, sf)
    out = features.rolling_features(df, lay, CH, 10, 0.5, (), cross_channel=True)
    return out.select("series_id", "w", *[r6(c).alias(c) for c in _CROSS])


def _ablation_sql():
    parts = []
    stats = {}
    for c in CH:
        stats |= sql_stats(c, c, PREFIXES[:7])
    for group, feats in features.GROUPS.items():
        names = [f"{features.PREFIX[f]}_{c}" for c in CH for f in feats] + (list(_CROSS) if group == "all" else [])
        parts.append(f"SELECT '{group}' AS \"group\", series_id, w, {len(names)} AS n_features, {sql_r6(' + '.join(names), 4)} AS total FROM ft")
    table = ", ".join(f"{e} AS {n}" for n, e in {**stats, **_CROSS}.items())
    return v.with_ctes(*FILLED, sql_windows("p", 10, 5), sql_centred(CH),
                       f"ft AS (SELECT series_id, w, {table} FROM wc GROUP BY 1, 2)", tail=" UNION ALL ".join(parts))


@query("ablation_groups", _ablation_sql())
def ablation_groups(spark, sf):
    df, lay = filled_panel(spark, sf)
    full = features.rolling_features(df, lay, CH, 10, 0.5)
    out = features.ablation_long(full, lay, CH)
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("group", "series_id", "w", F.size("features").alias("n_features"), r6(total, 4).alias("total"))


_KURT = {n: e for c in CH for n, e in sql_stats(c, c, PREFIXES[:7]).items() if n.startswith("kurt_")}


@query("feature_subset", v.with_ctes(*FILLED, sql_windows("p", 10, 5), sql_centred(CH), f"ft AS (SELECT series_id, w, {', '.join(f'{e} AS {n}' for n, e in _KURT.items())} FROM wc GROUP BY 1, 2)",
    tail=f"SELECT series_id, w, {len(_KURT)} AS n_features, {', '.join(f'{sql_r6(n)} AS {n}' for n in _KURT)} FROM ft"))
def feature_subset(spark, sf):
    """Numeric columns of the feature table with one prefix."""
    df, lay = filled_panel(spark, sf)
    full = features.rolling_features(df, lay, CH, 10, 0.5)
    names = clean.columns_with_prefix(clean.numeric_columns(full, ("series_id", "w")), "kurt_")
    return full.select("series_id", "w", F.lit(len(names)).alias("n_features"), *[r6(c).alias(c) for c in names])


@query("feature_sequences", v.with_ctes(*READ, tail=f"""SELECT series_id, {sql_stamp('ts')} AS ts, 10::INTEGER AS n_values, {sql_r6('x[1]')} AS oldest, {sql_r6('x[5]')} AS newest,
 {sql_r6('list_sum(x) + list_sum(list_transform(x, lambda y: abs(y)))')} AS total
FROM (SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM p) WHERE pos >= 4"""))
def feature_sequences(spark, sf):
    """Design rows (the reading and its size) side by side, five at a time: oldest first."""
    df, lay = _positioned(spark, sf)
    rows = features.design_matrix(df.withColumn("size", F.abs("value")), ["value", "size"])
    out = features.sequences(rows, lay, 5)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("series_id", stamp("ts").alias("ts"), F.size("sequence").alias("n_values"), r6(F.get("sequence", F.lit(0))).alias("oldest"),
                      r6(F.get("sequence", F.lit(8))).alias("newest"), r6(total).alias("total"))


_SCALES = (5, 10, 20)
_CORE = ("rms", "kurt", "crest")


def _multiscale_sql():
    ctes = list(READ)
    for size in _SCALES:
        step = max(1, int(size * 0.5))
        ctes += [sql_windows("p", size, step, f"w{size}"), sql_centred(["value"], f"w{size}", f"c{size}"),
                 f"f{size} AS (SELECT series_id, w, max(ts) FILTER (pos = w * {step} + {size // 2}) AS ts, "
                 + ", ".join(f"{e} AS {n}_w{size}" for n, e in sql_stats('value', 'value', _CORE).items()) + f" FROM c{size} GROUP BY 1, 2)"]
    for size in _SCALES[:-1]:
        cols = ", ".join(f"r.{p}_value_w{size}" for p in _CORE)
        ctes.append(f"j{size} AS (SELECT l.series_id, l.w, {cols} FROM f20 l JOIN f{size} r ON l.series_id = r.series_id "
                    f"AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 43200000000 QUALIFY row_number() OVER (PARTITION BY l.series_id, l.w "
                    f"ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts DESC) = 1)")
    cols = ", ".join(f"{sql_r6(f'{p}_value_w{s}')} AS {p}_value_w{s}" for s in _SCALES for p in _CORE)
    return v.with_ctes(*ctes, tail=f"SELECT series_id, w, {sql_stamp('ts')} AS center_ts, {cols} FROM f20 "
                       "LEFT JOIN j5 USING (series_id, w) LEFT JOIN j10 USING (series_id, w)")


@query("multiscale_features", _multiscale_sql())
def multiscale_features(spark, sf):
    df, lay = _positioned(spark, sf)
    out = features.multiscale_features(df, lay, ["value"], _SCALES, tolerance_seconds=43_200)
    return out.select("series_id", "w", stamp("ts").alias("center_ts"),
                      *[r6(f"{p}_value_w{s}").alias(f"{p}_value_w{s}") for s in _SCALES for p in _CORE])


@query("asof_nearest", v.with_ctes("""
l AS (SELECT user_id AS series_id, ts, event_id FROM events WHERE event_type = 'error'),
r AS (SELECT user_id AS series_id, ts, value FROM events WHERE event_type = 'view'),
j AS (SELECT l.event_id, r.value, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap FROM l JOIN r USING (series_id)
  QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts DESC) = 1)""",
    tail="SELECT event_id, series_id, value AS nearest, CASE WHEN gap <= 21600000000 THEN value END AS within_6h FROM l LEFT JOIN j USING (event_id)"))
def asof_nearest(spark, sf):
    _, lay = v.readings(spark, sf)
    events = v.table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    left = events.where("event_type = 'error'").select("series_id", "ts", "event_id")
    right = events.where("event_type = 'view'")
    any_time = asof.asof_nearest(left, right.select("series_id", "ts", F.col("value").alias("nearest")), lay, ["nearest"])
    return asof.asof_nearest(any_time, right.select("series_id", "ts", F.col("value").alias("within_6h")), lay, ["within_6h"], 21_600) \
               .select("event_id", "series_id", "nearest", "within_6h")


@query("snapshot_stats", v.with_ctes("""
d AS (SELECT user_id AS series_id, date_trunc('day', ts) AS day, value, value - avg(value) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS dv FROM events)""",
    tail=f"""SELECT series_id, {sql_stamp('day')} AS day, count(*) AS n, {sql_r6('sqrt(avg(value * value))')} AS rms,
 {sql_r6('CASE WHEN count(*) < 4 OR stddev_pop(value) < 1e-12 THEN 0.0e0 ELSE avg(dv ** 4) / avg(dv * dv) ** 2 - 3 END')} AS kurt,
 {sql_r6('CASE WHEN count(*) < 3 OR stddev_pop(value) < 1e-12 THEN 0.0e0 ELSE avg(dv ** 3) / avg(dv * dv) ** 1.5 END')} AS skew,
 {sql_r6('max(value) - min(value)')} AS p2p, {sql_r6('max(abs(value)) / (sqrt(avg(value * value)) + 1e-12)')} AS crest, {sql_r6('avg(dv * dv)')} AS var
FROM d GROUP BY 1, 2"""))
def snapshot_stats(spark, sf):
    df, _ = v.readings(spark, sf)
    days = df.withColumn("day", F.date_trunc("day", "ts"))
    x = F.col("value")
    out = features.snapshot_statistics(days, ["series_id", "day"], x).join(
        days.groupBy("series_id", "day").agg(F.count(F.lit(1)).alias("n")), ["series_id", "day"])
    return out.select("series_id", stamp("day").alias("day"), "n", *[r6(c).alias(c) for c in ("rms", "kurt", "skew", "p2p", "crest", "var")])


@query("short_series", "SELECT user_id AS series_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) < 60")
def short_series(spark, sf):
    df, lay = v.readings(spark, sf)
    return features.short_series(df, lay, 60)


# ---- sampling-rate sweep ----
RK = "series_id, mode, factor"
_MODES, _FACTORS = SamplingConfig().modes, SamplingConfig().factors
_SWEEP_FEATURES = [f"{p}_value" for p in PREFIXES[:7]]


def _rates_cte():
    pairs = ", ".join(f"('{m}', {f})" for m in _MODES for f in _FACTORS)
    return f"""
rt0 AS (SELECT series_id, spacing_min, mode, factor::BIGINT AS factor, 10 * spacing_min AS win, 15.0e0 * spacing_min AS hold,
  spacing_min * factor AS effective_min FROM sp, (VALUES {pairs}) g(mode, factor) WHERE spacing_min > 0),
rt1 AS (SELECT *, round_even(win / effective_min, 0)::BIGINT AS raw FROM rt0),
rt2 AS (SELECT *, greatest(3, raw) AS window_rows, raw < 3 AS window_floored FROM rt1),
rt3 AS (SELECT *, greatest(1, round_even(window_rows * 0.5e0, 0)::BIGINT) AS stride_rows FROM rt2),
rates AS (SELECT *, greatest(1, round_even(hold / (stride_rows * effective_min), 0)::BIGINT) AS persistence_windows FROM rt3)"""


_SPACING = ("gp AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY pos)) AS g FROM p)",
            "sp AS (SELECT series_id, quantile_cont(g / 6e7, 0.5) AS spacing_min FROM gp WHERE g IS NOT NULL GROUP BY 1)")
RATES = (v.SQL_MACHINE_LOG, v.sql_pos("readings"), *_SPACING, _rates_cte())


@query("derive_counts", v.with_ctes(*RATES, tail=f"""SELECT series_id, mode, factor, {sql_r6('effective_min')} AS effective_min, window_rows,
 stride_rows, persistence_windows, window_floored FROM rates"""))
def derive_counts(spark, sf):
    df, lay = v.machine_log(spark, sf)
    return sweeps.rate_table(settle(with_position(df, lay), lay), lay).select("series_id", "mode", "factor", r6("effective_min").alias("effective_min"),
                                             "window_rows", "stride_rows", "persistence_windows", "window_floored")


def _scored_windows(keys: str, extra: str = "", persistence: str = "3") -> tuple[str, ...]:
    """From feature windows ``ft`` to metrics ``met``: split, robust scale, both closed-form scores, alarms, per ``keys``."""
    scaled = ", ".join(f"({c} - {c}_2) / CASE WHEN {c}_3 = {c}_1 THEN 1 ELSE {c}_3 - {c}_1 END AS {c}" for c in _SWEEP_FEATURES)
    quart = ", ".join(f"quantile_cont({c}, {q}) FILTER (split = 'train') AS {c}_{i}" for c in _SWEEP_FEATURES for i, q in ((1, .25), (2, .5), (3, .75)))
    h = "sqrt(" + " + ".join(f"{c} * {c}" for c in _SWEEP_FEATURES) + ")"
    m = "(" + " + ".join(f"abs({c})" for c in _SWEEP_FEATURES) + f") / {len(_SWEEP_FEATURES)}.0e0"
    names = [k.strip() for k in keys.split(",")]
    on, own = " AND ".join(f"e.{k} = x.{k}" for k in names), ", ".join(f"x.{k}" for k in names)
    return (v.sql_pos("ft", "fp", keys), v.sql_split("fp", "fs"), f"""
qq AS (SELECT {keys}, {quart} FROM fs GROUP BY {keys}),
sx AS (SELECT {keys}, ts, split, split_pos, split_n, failure_time{extra}, {scaled} FROM fs JOIN qq USING ({keys})),
x AS (SELECT *, {h} AS h, {m} AS m FROM sx),
mm AS (SELECT {keys}, avg(h) AS hm, stddev_pop(h) AS hs, avg(m) AS mu, stddev_pop(m) AS ms FROM x WHERE split = 'train' GROUP BY {keys}),
e AS (SELECT {keys}, split, split_pos, 0.2e0 * m + 0.8e0 * mu AS e FROM x JOIN mm USING ({keys}) WHERE split_pos = 0
  UNION ALL SELECT {own}, x.split, x.split_pos, 0.2e0 * x.m + 0.8e0 * e.e FROM e JOIN x ON {on} AND e.split = x.split AND x.split_pos = e.split_pos + 1),
sc AS (SELECT x.*, 'three_sigma' AS method, abs((h - hm) / (hs + 1e-12)) AS score FROM x LEFT JOIN mm USING ({keys})
  UNION ALL SELECT x.*, 'ewma' AS method, abs(e - mu) / (ms + 1e-12) AS score FROM x LEFT JOIN mm USING ({keys}) LEFT JOIN e USING ({keys}, split, split_pos)),
thr AS (SELECT {keys}, method, quantile_cont(score, 0.975) FILTER (split = 'train') AS threshold FROM sc GROUP BY {keys}, method),
tst AS (SELECT *, max(CASE WHEN split_pos = least(floor(split_n * 0.05e0)::BIGINT, split_n - 1) THEN ts END)
    OVER (PARTITION BY {keys}, method) AS normal_end FROM sc JOIN thr USING ({keys}, method) WHERE split = 'test')""",
        v.sql_alarms(f"{keys}, method", persistence=persistence), v.sql_metrics(f"{keys}, method"))


def _sweep_ctes():
    stats = sql_stats("value", "value", PREFIXES[:7])
    return (*RATES, f"""
o AS (SELECT p.*, epoch_us(date_trunc('day', min(ts) OVER (PARTITION BY series_id))) AS o FROM p),
ra AS (SELECT o.*, mode, factor, greatest(1, round_even(spacing_min * factor, 0)::BIGINT) * 60000000 AS us FROM o JOIN rates USING (series_id)),
rr AS (SELECT series_id, mode, factor, ts, value FROM ra WHERE factor = 1 OR (mode = 'decimate' AND pos % factor = 0)
  UNION ALL SELECT series_id, mode, factor, make_timestamp(o + (epoch_us(ts) - o) // us * us) AS bin, avg(value) FROM ra
  WHERE factor > 1 AND mode = 'aggregate' GROUP BY 1, 2, 3, 4)""",
        v.sql_pos("rr", "q", RK), f"""
eg AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {RK} ORDER BY pos)) AS g FROM q),
es AS (SELECT {RK}, quantile_cont(g / 6e7, 0.5) AS effective_interval_min FROM eg WHERE g IS NOT NULL GROUP BY {RK}),
qw AS (SELECT q.*, window_rows, window_floored, persistence_windows, greatest(1, floor(window_rows * 0.5e0)::BIGINT) AS step FROM q JOIN rates USING ({RK})),
wd AS (SELECT *, unnest(generate_series(greatest(0, ceil((pos - window_rows + 1) / step::DOUBLE)::BIGINT), least(pos // step, (n - window_rows) // step))) AS w
  FROM qw WHERE n >= window_rows)""",
        sql_centred(["value"], keys=f"{RK}, w"), f"""
ft AS (SELECT {RK}, w, max(ts) FILTER (pos = w * step + window_rows // 2) AS ts, any_value(persistence_windows) AS persistence_windows,
  any_value(window_rows) AS window_rows, any_value(window_floored) AS window_floored, {v.SQL_FAIL} AS failure_time,
  {', '.join(f'{e} AS {n}' for n, e in stats.items())} FROM wc GROUP BY {RK}, w)""",
        *_scored_windows(RK, ", persistence_windows, window_rows, window_floored",
                         "any_value(persistence_windows) OVER (PARTITION BY " + RK + ", method)"), f"""
av AS (SELECT series_id, max((epoch_us(failure_time) - epoch_us(normal_end)) / 3.6e9) AS avail FROM met WHERE factor = 1 GROUP BY 1),
sw AS (SELECT {RK}, method, round(effective_interval_min, 2) AS effective_interval_min, round(vlt_hours, 2) AS vlt_hours,
  round(CASE WHEN avail > 0 THEN least(1.0e0, greatest(0.0e0, round(vlt_hours, 2) / avail)) END, 4) AS vlt_norm,
  CASE WHEN avail > 0 THEN round(avail, 2) END AS available_lead_hours, round(far_pct, 2) AS far_pct, fat, valid_alarm, n_test AS n_test_windows
  FROM met JOIN es USING ({RK}) LEFT JOIN av USING (series_id))""")


@query("sampling_sweep", v.with_ctes(*_sweep_ctes(), tail=f"SELECT {RK}, method, {sql_r6('effective_interval_min', 2)} AS effective_interval_min, "
    f"{sql_r6('vlt_hours', 2)} AS vlt_hours, {sql_r6('vlt_norm', 4)} AS vlt_norm, {sql_r6('available_lead_hours', 2)} AS available_lead_hours, "
    f"{sql_r6('far_pct', 2)} AS far_pct, {sql_stamp('fat')} AS fat, valid_alarm, n_test_windows FROM sw"))
def sampling_sweep(spark, sf):
    df, lay = v.machine_log(spark, sf)
    return _sweep_columns(sweeps.sampling_sweep(df, lay, ["value"]))


@query("model_sweep")
def model_sweep(spark, sf):
    """The sweep with every configured method; its closed-form rows are those of ``sampling_sweep``."""
    df, lay = v.machine_log(spark, sf)
    cfg = ModelConfig()
    return _sweep_columns(sweeps.sampling_sweep(df, lay, ["value"], methods=cfg.methods, options=cfg.params))


def _sweep_columns(out):
    return out.select("series_id", "mode", "factor", "method", r6("effective_interval_min", 2).alias("effective_interval_min"),
                      r6("vlt_hours", 2).alias("vlt_hours"), r6("vlt_norm", 4).alias("vlt_norm"),
                      r6("available_lead_hours", 2).alias("available_lead_hours"), r6("far_pct", 2).alias("far_pct"),
                      stamp("fat").alias("fat"), "valid_alarm", "n_test_windows")


_AGG = {"VLT_hours": "vlt_hours", "VLT_norm": "vlt_norm", "FAR_pct": "far_pct"}


@query("sampling_aggregate", v.with_ctes(*_sweep_ctes(), tail="SELECT mode, factor, effective_interval_min, method, " + ", ".join(
    f"{sql_r6(f'avg({c})', 4)} AS {o}_mean, {sql_r6(f'coalesce(stddev_samp({c}), 0)', 4)} AS {o}_std, {sql_r6(f'median({c})', 4)} AS {o}_median"
    for o, c in _AGG.items()) + f", {sql_r6('min(vlt_norm)', 4)} AS VLT_norm_min, {sql_r6('max(vlt_norm)', 4)} AS VLT_norm_max, count(DISTINCT series_id) AS n_runs FROM sw GROUP BY 1, 2, 3, 4"))
def sampling_aggregate(spark, sf):
    df, lay = v.machine_log(spark, sf)
    sweep = cut_lineage(sweeps.sampling_sweep(df, lay, ["value"]), "sweep")
    out = sweeps.sampling_aggregate(sweep, lay)
    cols = [f"{o}_{s}" for o in _AGG for s in ("mean", "std", "median")] + ["VLT_norm_min", "VLT_norm_max"]
    return out.select("mode", "factor", r6("effective_interval_min", 2).alias("effective_interval_min"), "method", *[r6(c, 4).alias(c) for c in cols], "n_runs")


# ---- whole experiments on feature windows ----
_WINDOW_SCALES = {"30": (30,), "60": (60,), "180": (180,)}
_CLOSED = replace(ExperimentConfig(), models=ModelConfig(methods=("three_sigma", "ewma")))


def _scale_ctes(sizes) -> tuple[str, ...]:
    stats = sql_stats("value", "value", PREFIXES[:7])
    listed = ", ".join(f"({s})" for s in sizes)
    return (v.SQL_MACHINE_LOG, v.sql_pos("readings"), f"""
wd AS (SELECT p.*, size, size // 2 AS step,
  unnest(generate_series(greatest(0, ceil((pos - size + 1) / (size // 2)::DOUBLE)::BIGINT), least(pos // (size // 2), (n - size) // (size // 2)))) AS w
  FROM p, (VALUES {listed}) g(size) WHERE n >= size)""",
        sql_centred(["value"], keys="series_id, size, w"), f"""
ft AS (SELECT series_id, size, w, max(ts) FILTER (pos = w * step + size // 2) AS ts, {v.SQL_FAIL} AS failure_time,
  {', '.join(f'{e} AS {n}' for n, e in stats.items())} FROM wc GROUP BY series_id, size, w)""",
        *_scored_windows("series_id, size"))


_SUMMARY = (f"series_id, method, {sql_stamp('fat')} AS fat, {sql_r6('vlt_hours', 2)} AS vlt_hours, "
            f"{sql_r6('far_pct', 2)} AS far_pct, valid_alarm")


def _summary(out):
    return ["series_id", "method", stamp("fat").alias("fat"),
            r6("vlt_hours", 2).alias("vlt_hours"), r6("far_pct", 2).alias("far_pct"), "valid_alarm"]


@query("experiment_metrics", v.with_ctes(*_scale_ctes((30,)), tail=f"SELECT {_SUMMARY}, {sql_r6('threshold', 4)} AS threshold FROM met WHERE threshold IS NOT NULL"))
def experiment_metrics(spark, sf):
    df, lay = v.machine_log(spark, sf)
    runs = df.groupBy("series_id").agg(F.any_value("failure_time").alias("failure_time"))
    rows, _ = pipeline.feature_pipeline(df.drop("failure_time"), lay, ["value"], _CLOSED, window=30)
    out = pipeline.compare_methods(rows, lay, runs, _CLOSED)
    return out.select(*_summary(out), r6("threshold", 4).alias("threshold"))


@query("scale_comparison", v.with_ctes(*_scale_ctes((30, 60, 180)), tail=f"SELECT size::VARCHAR AS scale, {_SUMMARY} FROM met WHERE threshold IS NOT NULL"))
def scale_comparison(spark, sf):
    df, lay = v.machine_log(spark, sf)
    runs = df.groupBy("series_id").agg(F.any_value("failure_time").alias("failure_time"))
    out = pipeline.scale_metrics(df.drop("failure_time"), lay, ["value"], runs, _WINDOW_SCALES, _CLOSED)
    return out.select("scale", *_summary(out))


def _experiment(spark, sf):
    df, lay = v.machine_log(spark, sf)
    return df.drop("failure_time"), lay, df.groupBy("series_id").agg(F.any_value("failure_time").alias("failure_time"))


@query("model_experiment")
def model_experiment(spark, sf):
    """Every configured method on the windows of ``experiment_metrics``."""
    df, lay, runs = _experiment(spark, sf)
    rows, _ = pipeline.feature_pipeline(df, lay, ["value"], window=30)
    out = pipeline.compare_methods(rows, lay, runs, ExperimentConfig())
    return out.select(*_summary(out), r6("threshold", 4).alias("threshold"))


@query("model_scales")
def model_scales(spark, sf):
    """Every configured method at the scales of ``scale_comparison``."""
    df, lay, runs = _experiment(spark, sf)
    out = pipeline.scale_metrics(df, lay, ["value"], runs, _WINDOW_SCALES)
    return out.select("scale", *_summary(out))


@query("conformal_forest")
def conformal_forest(spark, sf):
    """Forest scores to conformal p-values, persistent alarms below 0.05, and their lead and false-alarm rate."""
    df, lay, runs = _experiment(spark, sf)
    rows, _ = pipeline.feature_pipeline(df, lay, ["value"], window=30)
    cfg = ModelConfig()
    detector, = build_detectors(("isolation_forest",), "features", cfg.params)
    rows = settle(rows, lay, "features")
    p_values = uncertainty.conformal_pvalues(uncertainty.conformal_calibrate(detector, rows, lay), lay)
    out = evaluate.conformal_metrics(p_values.join(runs, "series_id"), lay, 0.05).withColumn("method", F.lit("conformal_forest"))
    return out.select(*_summary(out), r6("threshold", 4).alias("threshold"))
