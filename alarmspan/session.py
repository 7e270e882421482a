"""Session settings and the shared folder for cut lineage."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Spark 4.1 can report a union's partitioning with unequal partition counts once adaptive execution has merged the
# partitions of one side, and then fails to plan a join above it.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def build_session(app_name: str = "alarmspan", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, ANSI, adaptive execution)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Only matters for exchanges below a few megabytes, where merging to one task would serialise the work.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        UNION_PARTITIONING: "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Naive timestamps are read as UTC whatever zone the caller's session had."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the session's checkpoint folder.

    Where neither is set, a local master gets a fresh temporary folder; a cluster gets one beside its tables if the
    warehouse is in a shared store, and otherwise has to name one, since each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder is None and current.isDefined():
        folder = current.get()
    if folder is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{warehouse.rstrip('/')}/_scratch"
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; for when their results have been read."""
    jvm, removed = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: survives executor loss, keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ships(table: DataFrame) -> bool:
    """Whether the planner ships a written table to the rows it is joined to, from its size alone."""
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
