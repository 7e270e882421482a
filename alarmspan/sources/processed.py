"""Processed tables: cleaned and resampled series in Parquet, reused when present; CSV result sinks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmspan.functions.timeparse import hours_to_failure
from alarmspan.layout import Layout
from alarmspan.operators.clean import clip_spikes, fill_missing, numeric_columns
from alarmspan.operators.ordered import settle, with_position
from alarmspan.operators.resample import resample_mean
from alarmspan.session import cut_lineage
from alarmspan.sources.waveform import path_exists


def table_path(root: str, freq_minutes: float) -> str:
    """The grid width is part of the path, so tables of different rates never stand in for each other."""
    return f"{root.rstrip('/')}/freq={freq_minutes:g}min"


def save_processed(df: DataFrame, root: str, freq_minutes: float, mode: str = "append") -> str:
    """Parquet partitioned by series; rows are exchanged so that a partition is written by few tasks, a long series by
    several (hashed by day)."""
    path = table_path(root, freq_minutes)
    spread = df.repartition("series_id", F.to_date("ts"))
    spread.write.mode(mode).partitionBy("series_id").parquet(path)
    return path


def load_processed(spark: SparkSession, root: str, freq_minutes: float) -> DataFrame:
    return spark.read.parquet(table_path(root, freq_minutes)).withColumn("series_id", F.col("series_id").cast("string"))


def preprocess(df: DataFrame, lay: Layout, runs: DataFrame | None = None, freq_minutes: float = 10.0,
               cols: Sequence[str] | None = None, method: str = "ffill", max_gap: int = 5, z: float = 10.0) -> DataFrame:
    """Fill gaps, clip spikes, resample, and add hours to failure where ``runs`` knows the failure time."""
    cols = list(cols or numeric_columns(df))
    rows = settle(with_position(df, lay), lay, "preprocess")
    filled = settle(fill_missing(rows, lay, cols, method, max_gap), lay, "filled")
    grid = resample_mean(clip_spikes(filled, lay, cols, z), lay, cols, freq_minutes)
    if runs is None:
        return grid
    known = runs.select("series_id", "failure_time")
    return grid.join(known, "series_id", "left") \
               .withColumn("hours_to_failure", hours_to_failure(F.col("ts"), F.col("failure_time"))).drop("failure_time")


def source_marks(source: DataFrame, options: str) -> DataFrame:
    """What a series' processed rows depend on: rows, first and last time, a hash of all its rows, and the options."""
    rows = F.bit_xor(F.xxhash64(*sorted(source.columns)))
    return source.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), rows.alias("rows")) \
                 .withColumn("options", F.lit(options))


def read_or_build(spark: SparkSession, source: DataFrame, root: str, runs: DataFrame | None = None,
                  freq_minutes: float = 10.0, **options) -> DataFrame:
    """Processed rows of every series in ``source``; only what is missing or out of date is built.

    A manifest beside the table keeps the marks of the rows each series was built from.  A series whose rows have changed
    since (some came later, or were replaced), or that was built with other options, is built anew in place of its old
    partition.  The manifest is written after the table, so that a build that broke off is done again.
    """
    marks = ["n", "first", "last", "rows", "options"]
    table, manifest = table_path(root, freq_minutes), f"{root.rstrip('/')}/manifest/freq={freq_minutes:g}min"
    source = source.withColumn("series_id", F.col("series_id").cast("string"))
    now = source_marks(source, repr(sorted(options.items())) + ("" if runs is None else " with failure times"))
    stale = now
    if path_exists(spark, manifest):
        built = spark.read.parquet(manifest)
        latest = built.groupBy("series_id").agg(F.max_by(F.struct(*marks), "version").alias("built"))
        known = latest.select("series_id", *[F.col(f"built.{m}").alias(m) for m in marks])
        stale = now.join(known, ["series_id", *marks], "left_anti")
        version = built.agg(F.max("version")).first()[0] + 1
    else:
        version = 1
    stale = cut_lineage(stale, "stale-series")
    if not stale.isEmpty():
        rows = source.join(stale.select("series_id"), "series_id", "left_semi")
        spread = preprocess(rows, Layout.measure(rows), runs, freq_minutes, **options).repartition("series_id", F.to_date("ts"))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series_id").parquet(table)
        stale.withColumn("version", F.lit(version)).write.mode("append").parquet(manifest)
    return load_processed(spark, root, freq_minutes).join(now.select("series_id"), "series_id", "left_semi")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table as CSV with a header; one file per task, never gathered."""
    df.write.mode(mode).option("header", True).csv(path)
