"""Raw waveform snapshots: one delimited text file per snapshot, one column per channel."""
from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alarmspan.functions import stats
from alarmspan.functions.timeparse import timestamp_from_name
from alarmspan.session import cut_lineage

log = logging.getLogger(__name__)

SNAPSHOT_STATS = ("rms", "kurt", "skew", "p2p", "crest", "var")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _present(spark: SparkSession, root: str, runs: Sequence[str]) -> list[str]:
    """Directories of the runs that exist; a missing one is reported."""
    present = []
    for run in runs:
        if path_exists(spark, f"{root}/{run}"):
            present.append(f"{root}/{run}")
        else:
            log.warning("run directory not found, skipped: %s/%s", root, run)
    if not present:
        raise FileNotFoundError(f"none of {list(runs)} under {root}")
    return present


def _file_keys(path: str = "path") -> list[Column]:
    return [F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("series_id"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name")]


def _unnamed_ranks(spark: SparkSession, folders: Sequence[str], keep_seconds: bool) -> DataFrame | None:
    """Rank in name order of the files of runs that hold names without a time; None when every name holds one.

    Works on the file listing alone.  Names are range-partitioned, so a run of any size is numbered by many tasks:
    files before a partition plus position inside it.  The partition of a name is written down, since it is not
    guaranteed to come out the same twice.
    """
    files = spark.read.format("binaryFile").load(list(folders)).select("path").select(*_file_keys())
    unnamed = files.where(timestamp_from_name(F.col("name"), F.lit(None).cast("long"), keep_seconds).isNull())
    if unnamed.isEmpty():
        return None
    wanted = files.join(unnamed.select("series_id").distinct(), "series_id", "left_semi")
    placed = cut_lineage(wanted.repartitionByRange("series_id", "name").withColumn("_part", F.spark_partition_id()), "names")
    counts = placed.groupBy("series_id", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("series_id").orderBy("_part")  # one row per partition
    offsets = counts.select("series_id", "_part", (F.sum("_c").over(before) - F.col("_c")).alias("_offset"))
    inside = Window.partitionBy("series_id", "_part").orderBy("name")
    return placed.join(offsets, ["series_id", "_part"]).select(
        "series_id", "name", (F.col("_offset") + F.row_number().over(inside) - 1).alias("rank"))


def _lines(spark: SparkSession, present: Sequence[str], n_channels: int) -> DataFrame:
    """(series_id, path, name, channel, x, bad, width): one row per sample and channel."""
    text = spark.read.text(list(present)).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line"), F.col("_metadata.file_path").alias("path"))
    cells = F.transform(F.split("line", r"\s+"), lambda s: s.try_cast("double"))
    parsed = text.where("line <> ''").withColumn("cells", cells)
    parsed = parsed.select(
        *_file_keys(), "path",
        F.size("cells").alias("width"), F.exists("cells", lambda x: x.isNull()).alias("bad"),
        F.slice("cells", 1, n_channels).alias("cells"))
    return parsed.select("series_id", "path", "name", "width", "bad", F.posexplode("cells").alias("channel", "x"))


def waveform_samples(spark: SparkSession, root: str, runs: Sequence[str], n_channels: int = 8) -> DataFrame:
    """All samples in long form; a file with a ragged or unreadable line is left out whole."""
    rows = _lines(spark, _present(spark, root, runs), n_channels)
    bad = rows.groupBy("path").agg(F.max("bad").alias("b"), F.min("width").alias("lo"), F.max("width").alias("hi")) \
              .where(F.col("b") | (F.col("lo") != F.col("hi"))).select("path")
    return rows.join(bad, "path", "left_anti").drop("bad", "width")


def snapshot_table(spark: SparkSession, root: str, runs: Sequence[str], n_channels: int = 8, keep_seconds: bool = False) -> DataFrame:
    """One row per snapshot file with ``<stat>_ch<k>`` columns.

    One pass over the text: samples combine per (file, channel) before the exchange, and what makes a file unusable is
    aggregated along with the statistics instead of being looked up first.
    """
    x = F.col("x")
    folders = _present(spark, root, runs)
    per_channel = _lines(spark, folders, n_channels).groupBy("series_id", "path", "name", "channel").agg(
        stats.rms(x).alias("rms"), stats.snapshot_kurtosis(x).alias("kurt"), stats.snapshot_skewness(x).alias("skew"),
        stats.peak_to_peak(x).alias("p2p"), stats.crest(x).alias("crest"), F.var_pop(x).alias("var"),
        F.max("bad").alias("bad"), F.min("width").alias("lo"), F.max("width").alias("hi"))
    wide = per_channel.groupBy("series_id", "path", "name").agg(
        (F.max("bad") | (F.min("lo") != F.max("hi"))).alias("unusable"),
        *[F.max(F.when(F.col("channel") == k, F.col(s))).alias(f"{s}_ch{k}") for s in SNAPSHOT_STATS for k in range(n_channels)])
    ranks = _unnamed_ranks(spark, folders, keep_seconds)
    wide = wide.withColumn("rank", F.lit(None).cast("long")) if ranks is None else wide.join(ranks, ["series_id", "name"], "left")
    stamped = wide.withColumn("ts", timestamp_from_name(F.col("name"), F.col("rank"), keep_seconds))
    return stamped.where(~F.col("unusable")).drop("unusable", "path", "name", "rank")
