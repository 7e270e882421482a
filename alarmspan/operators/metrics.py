"""Lead-time metrics as aggregate expressions over an alarm stream."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alarmspan.functions.timeparse import hours_between


def first_alarm_time(alarm: Column, ts: Column) -> Column:
    return F.min(F.when(alarm, ts))


def valid_lead_hours(fat: Column, failure: Column, normal_end: Column | None = None) -> Column:
    """Hours from first alarm to failure; 0 without an alarm, at or after failure, or inside the normal period."""
    useless = fat.isNull() | (fat >= failure)
    if normal_end is not None:
        useless = useless | F.coalesce(fat <= normal_end, F.lit(False))
    return F.when(useless, F.lit(0.0)).otherwise(hours_between(failure, fat))


def false_alarm_rate(alarm: Column, ts: Column, normal_end: Column) -> Column:
    """Share of alarmed rows up to the end of the normal period, that row included."""
    return F.coalesce(F.avg(F.when(ts <= normal_end, alarm.cast("double"))), F.lit(0.0))


def detection_delay_hours(fat: Column, onset: Column) -> Column:
    delay = hours_between(fat, onset)
    return F.when(delay >= 0, delay)


def miss_rate(valid: Column) -> Column:
    return F.coalesce(F.avg((~valid).cast("double")), F.lit(1.0))


def normalised_lead(vlt: Column, available_hours: Column) -> Column:
    """Lead as a share of the longest achievable lead, clipped to [0, 1]; null when none is achievable."""
    return F.when(available_hours > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), vlt / available_hours)))
