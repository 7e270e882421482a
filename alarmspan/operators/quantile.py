"""Exact percentiles with linear interpolation between order statistics."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.detectors.chunks import emitted_by_series
from alarmspan.layout import Layout
from alarmspan.session import cut_lineage

_CELLS_PER_OCTAVE = 65_536


def value_cell(value: Column) -> Column:
    """Order-preserving cell of a double: octave and a slice of it, mirrored for negatives."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    slice_ = F.floor((size / F.pow(F.lit(2.0), octave) - 1.0) * F.lit(_CELLS_PER_OCTAVE))
    rank = (octave + F.lit(1100)) * F.lit(_CELLS_PER_OCTAVE) + slice_
    # Beyond all numbers: NaN sorts last, as Spark has it.
    end = F.lit(3000 * _CELLS_PER_OCTAVE)
    infinite = size == F.lit(float("inf"))
    return (F.when(F.isnan(value), end + 1).when(infinite, F.when(value > 0, end).otherwise(-end))
             .when(value == 0.0, F.lit(0)).when(value > 0, rank).otherwise(-rank).cast("long"))


def quantile_table(df: DataFrame, lay: Layout, value: Column, ranks: dict[str, float], accuracy: int | None = None) -> DataFrame:
    """One row per key with the exact percentile columns ``name -> p in [0, 1]`` of the non-null values.

    Whole layout: the built-in ``percentile``, whose state is bounded by the measured series length.  Otherwise the
    values are counted per (key, value cell); only the cells holding a wanted order statistic are sorted.
    ``accuracy`` opts in to one pass of bounded sketches instead (rank error at most n / accuracy, no interpolation).
    """
    keys = list(lay.keys)
    if accuracy is not None:
        return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, accuracy).alias(name) for name, p in ranks.items()])
    if lay.whole:
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in ranks.items()])
    values = (df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
                .withColumn("_cell", value_cell(F.col("_v"))))
    cells = values.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_cell")
    cells = (cells.withColumn("_upto", F.sum("_c").over(upto))
                  .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in ranks.items()]))
    targets = (cells.select(*keys, "_cell", "_c", "_upto", "_n", wanted.alias("_q"))
               .withColumn("_at", F.col("_q.p") * (F.col("_n") - 1))
               .withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at"))
               .where((F.col("_lo") < F.col("_upto")) & (F.col("_hi") >= F.col("_upto") - F.col("_c"))))
    needed = targets.groupBy(*keys, "_cell").agg(
        F.any_value(F.col("_upto") - F.col("_c")).alias("_below"),
        F.collect_list(F.struct("_q.name", "_at", "_lo", "_hi")).alias("_wants"))
    # Written: a few cells a key, which the planner then ships to the values instead of dealing those out once more.
    needed = cut_lineage(needed, "wanted-cells")
    # Equal values collapse before the sort, so a value repeated through a third of all rows is one row here.
    distinct = values.join(needed.select(*keys, "_cell"), [*keys, "_cell"], "left_semi") \
                     .groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_v")
    placed = (distinct.withColumn("_last", F.sum("_c").over(in_cell))
              .join(needed, [*keys, "_cell"])
              .withColumn("_to", F.col("_below") + F.col("_last") - 1)
              .withColumn("_from", F.col("_to") - F.col("_c") + 1)
              .select(*keys, "_v", "_from", "_to", F.explode("_wants").alias("_w")))
    holds = lambda r: (F.col("_from") <= F.col(r)) & (F.col(r) <= F.col("_to"))
    picked = (placed.groupBy(*keys, F.col("_w.name").alias("_name"))
              .agg(F.max(F.when(holds("_w._lo"), F.col("_v"))).alias("_a"),
                   F.max(F.when(holds("_w._hi"), F.col("_v"))).alias("_b"),
                   F.any_value(F.col("_w._at") - F.col("_w._lo")).alias("_t"))
              # Between equal order statistics there is nothing to weigh: a sum of parts of them may round away from them.
              .withColumn("_x", F.when((F.col("_t") == 0) | (F.col("_a") == F.col("_b")), F.col("_a"))
                                 .when(F.abs("_a") == float("inf"), (1 - F.col("_t")) * F.col("_a") + F.col("_t") * F.col("_b"))
                                 .otherwise(F.col("_a") + F.col("_t") * (F.col("_b") - F.col("_a")))))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in ranks])


# Columns whose percentiles are worth a pass of histograms instead of one sort or one aggregate a column; bits a pass fixes.
WIDE_COLUMNS, DIGIT = 64, 16
_DIGITS_DDL = "column int, prefix long, digit int, n long"


def sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit numbers in the same order; both zeros are one."""
    bits = np.ascontiguousarray(values + 0.0, np.float64).view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def unsorted(keys: np.ndarray) -> np.ndarray:
    positive = keys >> np.uint64(63) == 1
    return np.where(positive, keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def column_quantiles(df: DataFrame, lay: Layout, cols: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """Exact percentiles of many columns at once: one row per series and column position (keys, column, quantiles).

    Radix selection.  The wanted order statistics of a column share their leading bits with ever fewer values: a pass
    counts, for all columns together, the next 16 bits of the values that still match, and four passes leave the values
    themselves.  A task holds counts by digit and never values, series or columns as a whole; what leaves it are the digits
    that occur.  The digits fixed so far travel as a table, a row per series.  Nulls and NaN take no part; a column without
    a value gives null.  Percentiles lie between order statistics in proportion, as elsewhere.
    """
    keys = list(lay.keys)
    rows = df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    width = len(cols)

    def digits(shift: int):
        def count(part: pd.DataFrame, own: dict | None) -> pd.DataFrame:
            x = np.array(part["_v"].tolist(), dtype=float).reshape(-1, width)
            found = []
            targets: dict[int, list[int]] = {}
            if own is not None:
                for c, p in zip(own["columns"], own["prefixes"]):
                    targets.setdefault(int(c), []).append(int(p))
            for c in range(width):
                values = sortable(x[~np.isnan(x[:, c]), c])
                lead = values >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros(len(values), np.uint64)
                for prefix in targets.get(c, [] if own is not None else [0]):
                    some = values[lead == np.uint64(prefix)] >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)
                    digit, n = np.unique(some, return_counts=True)
                    found.append(pd.DataFrame({"column": c, "prefix": prefix, "digit": digit.astype(np.int64), "n": n}))
            return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("column", "prefix", "digit", "n")})
        return count

    def fixed(counts: DataFrame, wanted: DataFrame | None) -> DataFrame:
        """Wanted order statistics with one more digit fixed: (keys, column, name, prefix, place among those that match)."""
        by = [*keys, "column", "prefix"]
        upto = Window.partitionBy(*by).orderBy("digit")
        counts = counts.groupBy(*by, "digit").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
        if wanted is None:
            total = counts.groupBy(*by).agg(F.max("upto").alias("total"))
            names = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(ranks)]))
            at = total.select(*by, "total", names.alias("r")).withColumn("at", F.col("r.p") * (F.col("total") - 1))
            ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor("at").alias("place")), F.struct(F.lit(1).alias("end"), F.ceil("at").alias("place"))))
            wanted = at.select(*by, F.col("r.i").alias("i"), (F.col("at") - F.floor("at")).alias("share"), ends.alias("e")) \
                       .select(*by, "i", "share", "e.end", "e.place")
        met = wanted.join(counts, by).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        return met.select(*keys, "column", "i", "share", "end", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place"),
                          (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix"))

    wanted = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        state = None
        if wanted is not None:
            state = wanted.select(*keys, "column", "prefix").distinct().groupBy(*keys).agg(
                F.collect_list(F.struct("column", "prefix")).alias("t")).select(
                *keys, F.transform("t", lambda t: t["column"]).alias("columns"), F.transform("t", lambda t: t["prefix"]).alias("prefixes"))
            state = cut_lineage(state, "digits")
        wanted = cut_lineage(fixed(emitted_by_series(rows, keys, digits(shift), f"{head}, {_DIGITS_DDL}", state), wanted), "order-statistics")

    @F.pandas_udf("double")
    def value(prefix: pd.Series) -> pd.Series:
        return pd.Series(unsorted(prefix.to_numpy(np.int64).view(np.uint64)))
    ends = wanted.withColumn("x", value("prefix")).groupBy(*keys, "column", "i").agg(
        F.max(F.when(F.col("end") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("x"))).alias("b"), F.any_value("share").alias("t"))
    between = F.when(F.col("t") == 0, F.col("a")).otherwise((1 - F.col("t")) * F.col("a") + F.col("t") * F.col("b"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("x")))), lambda s: s["x"])
    return ends.groupBy(*keys, "column").agg(listed.alias("quantiles"))


def with_quantiles(df: DataFrame, lay: Layout, value: Column, ranks: dict[str, float]) -> DataFrame:
    """Add the percentile columns to every row of the series (null where the series has no value)."""
    keys = list(lay.keys)
    if lay.whole:
        series = Window.partitionBy(*keys)
        return df.withColumns({name: F.percentile(value, F.lit(p)).over(series) for name, p in ranks.items()})
    return df.join(cut_lineage(quantile_table(df, lay, value, ranks), "quantiles"), keys, "left")
