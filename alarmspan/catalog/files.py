"""Sources and sinks: events are written as snapshots, logs, processed and result tables, and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from alarmspan.catalog import views as v
from alarmspan.catalog.lead_time import EVALUATED, evaluated
from alarmspan.catalog.registry import query, r6, sql_r6, sql_stamp, stamp
from alarmspan.operators import health
from alarmspan.plans.evaluate import best_method
from alarmspan.session import scratch_path
from alarmspan.sources import logs, processed, waveform


def write_snapshots(spark, sf: str) -> str:
    """One delimited text file per machine and day: the value, and its distance from 50.

    Spark names the files it writes; each is moved to the name that holds its time, as a recorder would have called it.
    """
    root = scratch_path(spark, "snapshots")
    df, _ = v.machine_log(spark, sf)
    slot = F.date_format(F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 86_400) * 86_400), "yyyy.MM.dd.HH.mm.ss")
    lines = df.select(F.concat(F.lit("run"), F.col("series_id").cast("string")).alias("run"), slot.alias("snap"),
                      F.concat_ws("\t", F.col("value").cast("string"), (F.col("value") - 50).cast("string")).alias("line"))
    lines.repartition("run", "snap").write.partitionBy("run", "snap").text(f"{root}/written")
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for run in fs.listStatus(path(f"{root}/written")):
        if run.getPath().getName().startswith("run="):
            folder = f"{root}/runs/{run.getPath().getName()[4:]}"
            fs.mkdirs(path(folder))
            for snap in fs.listStatus(run.getPath()):
                for part in fs.listStatus(snap.getPath()):
                    fs.rename(part.getPath(), path(f"{folder}/{snap.getPath().getName()[5:]}"))
    return f"{root}/runs"


_SNAP = "make_timestamp(epoch_us(ts) - epoch_us(ts) % 86400000000)"


@query("waveform_snapshots", f"""
SELECT 'run' || (user_id % 5) AS series_id, {sql_stamp(_SNAP)} AS ts, {sql_r6('sqrt(avg(value * value))')} AS rms_ch0,
 {sql_r6('max(value) - min(value)')} AS p2p_ch0, {sql_r6('var_pop(value)')} AS var_ch0, {sql_r6('sqrt(avg((value - 50) * (value - 50)))')} AS rms_ch1,
 {sql_r6('max(abs(value - 50)) / (sqrt(avg((value - 50) * (value - 50))) + 1e-12)')} AS crest_ch1 FROM events GROUP BY ALL""")
def waveform_snapshots(spark, sf):
    """All machines in one read; a run that is not there is reported, not an error."""
    out = waveform.snapshot_table(spark, write_snapshots(spark, sf), [f"run{k}" for k in range(6)], n_channels=2)
    return out.select("series_id", stamp("ts").alias("ts"), *[r6(c).alias(c) for c in ("rms_ch0", "p2p_ch0", "var_ch0", "rms_ch1", "crest_ch1")])


@query("waveform_samples", f"""
SELECT series_id, channel, count(*) AS n, {sql_r6('min(x)')} AS lowest, {sql_r6('avg(x)')} AS mean FROM (
 SELECT 'run' || (user_id % 5) AS series_id, unnest([0, 1]) AS channel, unnest([value, value - 50]) AS x FROM events WHERE user_id % 5 < 3) GROUP BY ALL""")
def waveform_samples(spark, sf):
    rows = waveform.waveform_samples(spark, write_snapshots(spark, sf), ["run0", "run1", "run2"], n_channels=8)
    return rows.groupBy("series_id", "channel").agg(F.count(F.lit(1)).alias("n"), r6(F.min("x")).alias("lowest"), r6(F.avg("x")).alias("mean"))


# Hourly means of four event types stand for the four vibration channels of one machine.
_SENSORS = dict(zip(logs.VIBRATION, ("click", "purchase", "signup", "view")))


def _hourly(spark, sf):
    events = v.table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return events.groupBy(hour.alias("hour")).agg(*[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for c, e in _SENSORS.items()])


_SQL_HOURLY = "h AS (SELECT date_trunc('hour', ts) AS ts, " + ", ".join(
    f"avg(value) FILTER (event_type = '{e}') AS {c}" for c, e in _SENSORS.items()) + " FROM events GROUP BY 1)"
_SQL_BEFORE = f"b AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM h WHERE ts < {v.SQL_FAIL})"


def _write_log(df, path: str, spelling: dict[str, str], time: str) -> None:
    stamps = F.date_format("hour", logs.TIME_FORMAT).alias(time)
    df.select(stamps, *[F.col(c).cast("string").alias(name) for c, name in spelling.items()]).write.option("header", True).csv(path)


@query("turbine_log", v.with_ctes(_SQL_HOURLY, _SQL_BEFORE, tail=f"""
SELECT {sql_stamp('ts')} AS ts, CASE WHEN pos < floor(n * 0.6e0) THEN 'train' ELSE 'test' END AS split, {', '.join(f'{sql_r6(c)} AS {c}' for c in _SENSORS)},
 {sql_r6(f"(epoch_us((SELECT min(ts) FROM h WHERE ts >= {v.SQL_FAIL})) - epoch_us((SELECT max(ts) FROM b))) / 1e6")} AS gap_seconds FROM b"""))
def turbine_log(spark, sf):
    """Two log files around the shutdown; the failure time is the last hour of the first, as reading it demands."""
    hours, root = _hourly(spark, sf), scratch_path(spark, "turbine-log")
    failure = F.lit(v.FAILURE_TIME).cast("timestamp")
    for name, rows in (("before", hours.where(F.col("hour") < failure)), ("after", hours.where(F.col("hour") >= failure))):
        _write_log(rows, f"{root}/{name}", {c: c for c in _SENSORS}, logs.TIME_COLUMN)
    last = hours.where(F.col("hour") < failure).agg(F.max("hour").cast("string")).first()[0]
    rows, gap = logs.turbine_log(spark, f"{root}/before", f"{root}/after", last)
    seconds = F.lit(gap.first()["gap_seconds"])
    return rows.select(stamp("ts").alias("ts"), "split", *[r6(c).alias(c) for c in _SENSORS], r6(seconds).alias("gap_seconds"))


@query("tolerant_log", v.with_ctes(_SQL_HOURLY, tail=f"SELECT {sql_stamp('ts')} AS ts, {', '.join(f'{sql_r6(c)} AS {c}' for c in _SENSORS)} FROM h"))
def tolerant_log(spark, sf):
    """Headers spelled another way, an empty column and rows without a time: what is left is the log itself."""
    path = f"{scratch_path(spark, 'log')}/log"
    hours = _hourly(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    odd = hours.select(F.lit(None).cast("timestamp").alias("hour"), *[F.lit(1.0).alias(c) for c in _SENSORS], F.col("empty"))
    spelling = {c: f"C1 {c[4:-4]} mm/s" for c in _SENSORS} | {"empty": "spare"}
    _write_log(hours.unionByName(odd), path, spelling, "Date and time")
    out = logs.tolerant_log(spark, path)
    return out.select(stamp("ts").alias("ts"), *[r6(c).alias(c) for c in _SENSORS])


_SQL_GRID = """
lim AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS s FROM readings GROUP BY 1),
grid AS (SELECT series_id::VARCHAR AS series_id, date_trunc('hour', ts) AS ts, avg(least(greatest(value, m - 10 * s), m + 10 * s)) AS value,
  (epoch_us(date_trunc('hour', ts)) - epoch_us(any_value(failure_time))) / 3.6e9 AS hours FROM readings JOIN lim USING (series_id) GROUP BY 1, 2)"""


@query("processed_table", v.with_ctes(v.SQL_MACHINE_LOG, _SQL_GRID, tail=f"SELECT series_id, {sql_stamp('ts')} AS ts, {sql_r6('value')} AS value, {sql_r6('hours')} AS hours_to_failure FROM grid"))
def processed_table(spark, sf):
    """Built from the first half of the log, then read with the whole of it: the rows that came later are in."""
    df, _ = v.machine_log(spark, sf)
    rows = df.select("series_id", "ts", "value")
    runs = df.select(F.col("series_id").cast("string").alias("series_id"), "failure_time").distinct()
    root = scratch_path(spark, "processed")
    how = {"runs": runs, "freq_minutes": 60.0, "cols": ["value"]}
    processed.read_or_build(spark, rows.where("ts < TIMESTAMP '2024-01-15' AND series_id < 4"), root, **how)
    out = processed.read_or_build(spark, rows, root, **how)
    return out.select("series_id", stamp("ts").alias("ts"), r6("value").alias("value"), r6("hours_to_failure").alias("hours_to_failure"))


@query("csv_sink", v.with_ctes(*EVALUATED, tail=f"SELECT series_id, method, {sql_r6('vlt_hours')} AS vlt_hours, {sql_r6('far_pct')} AS far_pct, valid_alarm FROM met"))
def csv_sink(spark, sf):
    """The method comparison as a CSV table, read back with the types it was written with."""
    path = f"{scratch_path(spark, 'csv')}/comparison"
    table = evaluated(spark, sf).select("series_id", "method", r6("vlt_hours").alias("vlt_hours"), r6("far_pct").alias("far_pct"), "valid_alarm")
    processed.write_csv(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


@query("kpi_lead", v.with_ctes(*EVALUATED, """
bm AS (SELECT series_id, method, vlt_hours, far_pct FROM met WHERE valid_alarm QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY vlt_hours DESC, method) = 1),
ra AS (SELECT series_id, count(*) AS n_rows, max(value) AS peak, arg_max(value, ts) AS last_value FROM readings GROUP BY 1)""",
    tail=f"""SELECT series_id, n_rows, {sql_r6('peak')} AS peak, {sql_r6('last_value')} AS last_value, method AS best_method,
 {sql_r6('coalesce(vlt_hours, 0)')} AS best_lead_hours, {sql_r6('far_pct')} AS best_far_pct FROM ra LEFT JOIN bm USING (series_id)"""))
def kpi_lead(spark, sf):
    df, lay = v.readings(spark, sf)
    limits = health.baseline_limits(df, lay, ["value"])
    out = health.with_best_lead(health.key_figures(df, limits, lay, ["value"]), best_method(evaluated(spark, sf)), lay)
    return out.select("series_id", "n_rows", r6("peak").alias("peak"), r6("last_value").alias("last_value"), "best_method",
                      r6("best_lead_hours").alias("best_lead_hours"), r6("best_far_pct").alias("best_far_pct"))
