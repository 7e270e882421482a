"""Registered queries over the driver's tables, each beside the SQL it must agree with (when SQL can say it)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmspan.functions.stats import settled_round

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def stamp(ts) -> Column:
    """Timestamp as text with microseconds, the form both engines print alike."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c, digits: int = 6) -> Column:
    return settled_round(F.col(c) if isinstance(c, str) else c, digits)


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_r6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + 1e-9, {digits}) + 0.0)"
