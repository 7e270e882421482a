"""Equipment logs: CSV or Parquet tables with a timestamp column and one column per sensor."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmspan.functions.timeparse import parse_log_timestamp
from alarmspan.layout import Layout
from alarmspan.operators.asof import log_gap_seconds
from alarmspan.operators.ordered import with_position, with_totals
from alarmspan.operators.split import training_prefix

# Column names, timestamp format and defaults of the turbine log format.
TIME_COLUMN = "Time Stamp"
TIME_FORMAT = "dd-MM-yyyy'#' HH:mm:ss"
VIBRATION = ("LPC_DE_X_Vib", "LPC_DE_Y_Vib", "LPC_NDE_X_Vib", "LPC_NDE_Y_Vib")
SPEED = "Ncp"
TRAIN_FRACTION = 0.60
CHANNELS = {
    "LPC_DE_X_Vib": ("drive end x", "de_x", "mm/s", "vibration"),
    "LPC_DE_Y_Vib": ("drive end y", "de_y", "mm/s", "vibration"),
    "LPC_NDE_X_Vib": ("far end x", "nde_x", "mm/s", "vibration"),
    "LPC_NDE_Y_Vib": ("far end y", "nde_y", "mm/s", "vibration"),
    "Ncp": ("shaft speed", "speed", "RPM", "speed"),
}


def channel_table(spark: SparkSession) -> DataFrame:
    """Channel metadata as a small dimension."""
    return spark.createDataFrame([(c, *m) for c, m in CHANNELS.items()], "channel string, label string, short string, unit string, type string")


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A log as stored: Parquet with its types, or CSV text with repeated header names kept once (the first)."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = spark.read.option("header", False).csv(path)
    header = raw.first()
    names = [(h or "").strip() or f"column_{i}" for i, h in enumerate(header)]
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    is_header = F.lit(True)
    for c, h in zip(raw.columns, header):
        is_header = is_header & F.col(c).eqNullSafe(F.lit(h))
    rows = raw.where(~is_header)
    return rows.select(*[F.col(raw.columns[i]).alias(name) for name, i in sorted(first.items(), key=lambda kv: kv[1])])


def standard_name(header: str) -> str | None:
    """Standard channel of a header; the longer end marks are tested first, since one contains the other."""
    for mark, name in (("NDE_X", "LPC_NDE_X_Vib"), ("NDE_Y", "LPC_NDE_Y_Vib"), ("DE_X", "LPC_DE_X_Vib"), ("DE_Y", "LPC_DE_Y_Vib")):
        if mark in header:
            return name
    lowered = header.lower()
    return SPEED if any(m in lowered for m in ("ncp", "speed", "rpm")) else None


def tolerant_log(spark: SparkSession, path: str, fmt: str = "csv", series_id: str = "log") -> DataFrame:
    """Log with unknown header spelling: empty columns dropped, first column taken as the timestamp in any known
    format, sensor columns renamed, rows without a timestamp dropped."""
    raw = read_table(spark, path, fmt)
    filled = raw.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(raw.columns)]).first()
    cols = [c for i, c in enumerate(raw.columns) if filled[i] > 0]
    stamp_type = dict(raw.dtypes)[cols[0]]
    ts = F.col(f"`{cols[0]}`")
    ts = ts.cast("timestamp") if stamp_type.startswith("timestamp") else parse_log_timestamp(ts.cast("string"))
    sensors = {}
    for c in cols[1:]:
        sensors.setdefault(standard_name(c) or c, F.col(f"`{c}`").try_cast("double") if standard_name(c) else F.col(f"`{c}`"))
    out = raw.select(F.lit(series_id).alias("series_id"), ts.alias("ts"), *[e.alias(n) for n, e in sensors.items()])
    return out.where(F.col("ts").isNotNull())


def turbine_log(spark: SparkSession, before_path: str, after_path: str | None, failure_time: str, fmt: str = "csv",
                train_fraction: float = TRAIN_FRACTION, series_id: str = "log") -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``split`` train / test and vibration channels, one-row gap table).

    Reading a row fails unless the failure time lies inside the test part.
    """
    def read(path):
        raw = read_table(spark, path, fmt)
        stamp = F.to_timestamp(F.col(f"`{TIME_COLUMN}`").cast("string"), TIME_FORMAT)
        return raw.select(F.lit(series_id).alias("series_id"), stamp.alias("ts"), *[F.col(c).cast("double").alias(c) for c in VIBRATION if c in raw.columns])

    before = read(before_path)
    lay = Layout.measure(before)
    rows = with_position(before, lay).withColumn("split", F.when(training_prefix(train_fraction), "train").otherwise("test"))
    fail = F.lit(failure_time).cast("timestamp")
    in_test = F.when(F.col("split") == "test", F.col("ts"))
    rows = with_totals(rows, lay, {"_from": F.min(in_test), "_to": F.max(in_test)})
    inside = (fail >= F.col("_from")) & (fail <= F.col("_to"))
    checked = F.when(inside, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"failure time {failure_time} lies outside the test span")).cast("boolean"))
    rows = rows.where(checked).drop("_from", "_to").withColumn("failure_time", fail)
    gap = log_gap_seconds(before, read(after_path)) if after_path else None
    return rows, gap
