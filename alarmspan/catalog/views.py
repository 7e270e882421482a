"""Sensor-series views over the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.session import pin_utc

FAILURE_TIME = "2024-01-28 00:00:00"
CHANNELS = ("click", "error", "purchase", "signup", "view")
MATRIX_DIM = 64

_LAYOUTS: dict[tuple, Layout] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str, view: str, df: DataFrame, order: str = "ts") -> Layout:
    """Layout of a view, measured once per session and state of the folder: a table that has grown is measured again."""
    key = (spark.sparkContext.applicationId, sf_dir, view, hash(tuple(sorted(df.inputFiles()))))
    if key not in _LAYOUTS:
        _LAYOUTS[key] = Layout.measure(df, order=order)
    return _LAYOUTS[key]


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """One series per user: (series_id, ts, value, failure_time)."""
    events = table(spark, sf_dir, "events")
    df = events.select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value",
                       F.lit(FAILURE_TIME).cast("timestamp").alias("failure_time"))
    return df, measured(spark, sf_dir, "readings", df)


def machine_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """One dense series per machine (user_id % 5): the long-series counterpart of the readings."""
    events = table(spark, sf_dir, "events")
    df = events.select((F.col("user_id") % 5).alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value",
                       F.lit(FAILURE_TIME).cast("timestamp").alias("failure_time"))
    return df, measured(spark, sf_dir, "machine_log", df)


def panel(spark: SparkSession, sf_dir: str, hours: int = 12) -> tuple[DataFrame, Layout]:
    """Five machines with one channel per event type: mean value per slot of ``hours``; empty cells are null."""
    events = table(spark, sf_dir, "events")
    width = F.lit(hours * 3_600_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.timestamp_micros(micros - F.pmod(micros, width))
    df = (events.groupBy((F.col("user_id") % 5).alias("series_id"), slot.alias("ts"))
          .agg(*[F.avg(F.when(F.col("event_type") == c, F.col("value"))).alias(c) for c in CHANNELS]))
    return df, measured(spark, sf_dir, f"panel{hours}", df)


def matrix(spark: SparkSession, sf_dir: str, one_series: bool = False) -> tuple[DataFrame, Layout]:
    """Feature rows from the embeddings, in id order: (series_id, ts, features)."""
    emb = table(spark, sf_dir, "embeddings")
    df = emb.select((F.lit(0) if one_series else F.col("label")).cast("long").alias("series_id"),
                    F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 60).alias("ts"),
                    F.col("embedding").cast("array<double>").alias("features"))
    return df, measured(spark, sf_dir, f"matrix{int(one_series)}", df)


# The same views in SQL.
SQL_FAIL = f"TIMESTAMP '{FAILURE_TIME}'"
SQL_READINGS = f"readings AS (SELECT user_id AS series_id, ts, value, {SQL_FAIL} AS failure_time FROM events)"


SQL_MACHINE_LOG = f"readings AS (SELECT user_id % 5 AS series_id, ts, value, {SQL_FAIL} AS failure_time FROM events)"


def sql_panel(hours: int = 12, name: str = "panel") -> str:
    width = hours * 3_600_000_000
    cols = ", ".join(f"avg(value) FILTER (event_type = '{c}') AS \"{c}\"" for c in CHANNELS)
    return (f"{name} AS (SELECT user_id % 5 AS series_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % {width}) AS ts, "
            f"{cols} FROM events GROUP BY ALL)")


def sql_pos(source: str, name: str = "p", keys: str = "series_id", order: str = "ts") -> str:
    return (f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY {keys}) AS n FROM {source})")


def sql_split(source: str = "p", name: str = "s", train: float = 0.5, cal: float = 0.1) -> str:
    a, b = f"floor(n * {train}e0)::BIGINT", f"floor(n * {train + cal}e0)::BIGINT"
    return (f"{name} AS (SELECT *, CASE WHEN pos < {a} THEN 'train' WHEN pos < {b} THEN 'cal' ELSE 'test' END AS split, "
            f"CASE WHEN pos < {a} THEN pos WHEN pos < {b} THEN pos - {a} ELSE pos - {b} END AS split_pos, "
            f"CASE WHEN pos < {a} THEN {a} WHEN pos < {b} THEN {b} - {a} ELSE n - {b} END AS split_n FROM {source})")


def sql_scores(lam: float = 0.2) -> str:
    """Three-sigma and smoothed-magnitude scores of the one-channel readings (CTE ``sc``)."""
    return f"""
mom AS (SELECT series_id, avg(abs(value)) AS mu, stddev_pop(abs(value)) + 1e-12 AS sd FROM s WHERE split = 'train' GROUP BY 1),
e AS (
  SELECT s.series_id, s.split, s.split_pos, {lam}e0 * abs(value) + {1 - lam}e0 * mu AS e
  FROM s JOIN mom USING (series_id) WHERE split_pos = 0
  UNION ALL
  SELECT s.series_id, s.split, s.split_pos, {lam}e0 * abs(s.value) + {1 - lam}e0 * e.e
  FROM e JOIN s ON s.series_id = e.series_id AND s.split = e.split AND s.split_pos = e.split_pos + 1),
sc AS (
  SELECT s.*, 'three_sigma' AS method, abs((abs(value) - mu) / sd) AS score FROM s JOIN mom USING (series_id)
  UNION ALL
  SELECT s.*, 'ewma' AS method, abs(e - mu) / sd AS score
  FROM s JOIN mom USING (series_id) JOIN e USING (series_id, split, split_pos))"""


def sql_alarms(keys: str, source: str = "tst", persistence: str = "3", name: str = "al") -> str:
    """Persistent alarms of ``source`` (score, threshold, split_pos) per ``keys``."""
    return f"""
{name}_h AS (SELECT *, coalesce(score > threshold, false) AS hit FROM {source}),
{name}_i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY split_pos) AS island FROM {name}_h),
{name} AS (SELECT *, hit AND sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, island) >= {persistence} AS alarm
  FROM {name}_i)"""


def sql_metrics(keys: str, source: str = "al", normal: bool = True, name: str = "met") -> str:
    early = " OR fat <= normal_end" if normal else ""
    valid = "vlt_hours > 0" if normal else "coalesce(fat < failure_time, false)"
    return f"""
{name}_a AS (SELECT {keys}, any_value(threshold) AS threshold, min(ts) FILTER (alarm) AS fat,
    coalesce(avg(CASE WHEN alarm THEN 1.0e0 ELSE 0.0e0 END) FILTER (ts <= normal_end), 0.0e0) * 100 AS far_pct,
    any_value(failure_time) AS failure_time, any_value(normal_end) AS normal_end, count(*) AS n_test FROM {source} GROUP BY {keys}),
{name}_b AS (SELECT *, CASE WHEN fat IS NULL OR fat >= failure_time{early} THEN 0.0e0
    ELSE (epoch_us(failure_time) - epoch_us(fat)) / 3.6e9 END AS vlt_hours FROM {name}_a),
{name} AS (SELECT *, fat IS NOT NULL AS alarm_raised, {valid} AS valid_alarm FROM {name}_b)"""


def sql_test_rows(keys: str, source: str = "sc", fraction: float = 0.05) -> str:
    """Test rows of ``source`` with the 97.5 % threshold of the train scores and the end of the normal period."""
    return f"""
thr AS (SELECT {keys}, quantile_cont(score, 0.975) AS threshold FROM {source} WHERE split = 'train' GROUP BY {keys}),
tst AS (SELECT *, max(CASE WHEN split_pos = least(floor(split_n * {fraction}e0)::BIGINT, split_n - 1) THEN ts END)
    OVER (PARTITION BY {keys}) AS normal_end FROM {source} JOIN thr USING ({keys}) WHERE split = 'test')"""


def with_ctes(*ctes: str, tail: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + tail
