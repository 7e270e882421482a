"""Timestamps from text and from file names; hours and gaps between timestamps; column short names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log formats accepted, tried in this order.
LOG_FORMATS = ("d-M-yyyy H:m:s", "yyyy-M-d H:m:s", "d/M/yyyy H:m:s",
               "d-M-yyyy H:m", "yyyy-M-d H:m", "d/M/yyyy H:m")
# Fixed value: first timestamp given to files whose name holds none.
UNNAMED_START = "2003-10-22 00:00:00"


def parse_log_timestamp(text: Column) -> Column:
    """Timestamp in any accepted log format (a ``#`` may separate date and time); NULL when none fits."""
    clean = F.regexp_replace(F.trim(text), "# ?", " ")
    tries = [F.try_to_timestamp(clean, F.lit(f)) for f in LOG_FORMATS]
    return F.coalesce(*tries, F.try_to_timestamp(clean))


def timestamp_from_name(name: Column, rank: Column, keep_seconds: bool = False) -> Column:
    """Timestamp of a snapshot file: dotted date, else Unix seconds, else one minute per file in name order.

    The last dotted part counts as the file's extension, so a dotted date loses its seconds unless ``keep_seconds``.
    """
    stem = name if keep_seconds else F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    dotted = r"^(\d+)\.(\d+)\.(\d+)\.(\d+)\.(\d+)(?:\.(\d+))?"
    part = lambda i: F.expr("int(0)") if i == 0 else F.regexp_extract(stem, dotted, i).try_cast("int")
    by_date = F.when(stem.rlike(dotted), F.try_make_timestamp(
        part(1), part(2), part(3), part(4), part(5), F.coalesce(part(6), F.lit(0)).cast("decimal(8,6)")))
    unix = stem.try_cast("double")
    by_unix = F.when(~F.isnan(unix), F.timestamp_micros(F.round(unix * 1e6).try_cast("long")))
    counted = F.timestamp_micros(F.unix_micros(F.lit(UNNAMED_START).cast("timestamp")) + rank.cast("long") * 60_000_000)
    return F.coalesce(by_date, by_unix, counted)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def hours_to_failure(ts: Column, failure_time: Column) -> Column:
    """Hours relative to failure, negative before it."""
    return hours_between(ts, failure_time)


def short_name(column: str) -> str:
    return column.replace("_", "")


def feature_name(prefix: str, column: str) -> str:
    return f"{prefix}_{short_name(column)}"


def pair_name(a: str, b: str) -> str:
    return f"corr_{short_name(a)}_{short_name(b)}"
