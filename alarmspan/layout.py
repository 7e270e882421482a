"""How rows of one series may be spread over tasks.

Order-dependent operators are cheapest when a whole series sits in one task (one exchange, one sort).  That is only
sound while the longest series fits a task, so a ``Layout`` carries the *measured* length of the longest series.
Without a measurement, or beyond ``block_rows``, operators run over blocks of ``block_rows`` consecutive rows and
exchange only small per-block summaries, so a series holding a third of all rows is spread like any other.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000
SECOND_US = 1_000_000
DEFAULT_BLOCK_ROWS = 500_000
# A block's rows unpacked: wide rows make shorter blocks.
BLOCK_BYTES = 1 << 30


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes unpacked."""
    def cell(name: str, kind) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        return F.lit(8)
    return sum((cell(f.name, f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...] = ("series_id",)
    order: str = "ts"
    max_rows: int | None = None
    block_rows: int = DEFAULT_BLOCK_ROWS
    cell_us: int = DAY_US
    rows: int | None = None

    @property
    def whole(self) -> bool:
        """True when every series has been measured to fit one task."""
        return self.max_rows is not None and self.max_rows <= self.block_rows

    @property
    def tasks(self) -> int | None:
        """How many tasks whole series have to be dealt to, so that one holds about half of ``block_rows`` rows however many
        series there are; None where the default does.  Tasks are else merged by the size of compressed exchanges, which
        says little about sorted rows and lets a task grow with the table."""
        if not self.whole or self.rows is None or self.rows <= 4 * self.block_rows:
            return None
        return -(-2 * self.rows // self.block_rows)

    def by(self, *extra: str) -> "Layout":
        """Same layout with more key columns (method, percentile, split ...); groups only get smaller.  How many rows they
        have together is not known: a column may be one of a fan-out."""
        return replace(self, keys=self.keys + tuple(k for k in extra if k not in self.keys), rows=None)

    @staticmethod
    def measure(df: DataFrame, keys: tuple[str, ...] = ("series_id",), order: str = "ts",
                block_rows: int = DEFAULT_BLOCK_ROWS) -> "Layout":
        """Count rows per series (map-side combined, one row returned) and pick a time cell that bounds a task.

        A block holds ``block_rows`` rows, fewer where the widest row would bring it above ``BLOCK_BYTES``.
        Only when a series exceeds it are time cells needed to number its rows.  The cell is narrowed
        until the fullest cell fits; at one second it is bounded by the microsecond resolution of the unique
        timestamps, so the loop ends.
        """
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.max(row_bytes(df)).alias("width"))
        longest, width, rows = counts.agg(F.max("count"), F.max("width"), F.sum("count")).first()
        block_rows = min(block_rows, max(1, BLOCK_BYTES // (width or 1)))
        lay = Layout(tuple(keys), order, int(longest or 0), block_rows, rows=int(rows or 0))
        while not lay.whole:
            cell = F.floor(F.unix_micros(F.col(order)) / F.lit(lay.cell_us))
            fullest = df.groupBy(*keys, cell.alias("cell")).count().agg(F.max("count")).first()[0]
            if fullest <= block_rows or lay.cell_us <= SECOND_US:
                break
            narrower = max(SECOND_US, int(lay.cell_us * block_rows / fullest / 2))
            lay = replace(lay, cell_us=narrower)
        return lay
