"""Lead-time analytics over fleets of run-to-failure sensor series, written as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``series_id`` so that a whole fleet is one job.  Ordered
operators also take a :class:`~alarmspan.layout.Layout`, which says whether the longest series has been measured to
fit one task; when it has not, the same operator runs over fixed-size row blocks instead.
"""
from alarmspan.layout import Layout
from alarmspan.session import build_session

__all__ = ["Layout", "build_session"]
