"""Column scaling fitted on the training rows of each series; parameters are a table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.layout import Layout
from alarmspan.operators.ordered import settle, with_totals
from alarmspan.operators.quantile import WIDE_COLUMNS, column_quantiles, quantile_table

KINDS = ("robust", "standard", "minmax")


def _unit_if_zero(c: Column) -> Column:
    return F.when(c == 0.0, F.lit(1.0)).otherwise(c)


def fit_scaler(df: DataFrame, lay: Layout, cols: list[str], kind: str = "robust", when: Column | None = None) -> DataFrame:
    """One row per series: ``<c>__center`` and ``<c>__scale``.  Constant columns scale by 1."""
    if kind not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}; choose one of {KINDS}")
    keys = list(lay.keys)
    rows = df.where(when) if when is not None else df
    if kind == "standard":
        return rows.groupBy(*keys).agg(
            *[F.avg(c).alias(f"{c}__center") for c in cols],
            *[_unit_if_zero(F.stddev_pop(c)).alias(f"{c}__scale") for c in cols])
    if kind == "minmax":
        return rows.groupBy(*keys).agg(
            *[F.min(c).cast("double").alias(f"{c}__center") for c in cols],
            *[_unit_if_zero((F.max(c) - F.min(c)).cast("double")).alias(f"{c}__scale") for c in cols])
    if len(cols) > WIDE_COLUMNS:
        table = column_quantiles(rows, lay, cols, (.25, .5, .75)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", "quantiles"))).alias("_q"))
        return table.select(
            *keys, *[F.try_element_at("_q", F.lit(i))[1].alias(f"{c}__center") for i, c in enumerate(cols)],
            *[_unit_if_zero(F.try_element_at("_q", F.lit(i))[2] - F.try_element_at("_q", F.lit(i))[0]).alias(f"{c}__scale") for i, c in enumerate(cols)])
    if lay.whole:
        quartiles = rows.groupBy(*keys).agg(
            *[F.percentile(c, F.array(F.lit(.25), F.lit(.5), F.lit(.75))).alias(f"_q_{c}") for c in cols])
        pick = lambda c: [F.col(f"_q_{c}")[i] for i in range(3)]
    else:
        long = rows.select(*keys, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_x")) \
            .select(*keys, "_x.column", "_x.v")
        table = quantile_table(long, lay.by("column"), F.col("v"), {"q1": .25, "q2": .5, "q3": .75})
        quartiles = table.groupBy(*keys).agg(*[
            F.max(F.when(F.col("column") == c, F.struct("q1", "q2", "q3"))).alias(f"_q_{c}") for c in cols])
        pick = lambda c: [F.col(f"_q_{c}")[q] for q in ("q1", "q2", "q3")]
    return settle(quartiles.select(
        *keys, *[pick(c)[1].alias(f"{c}__center") for c in cols],
        *[_unit_if_zero(pick(c)[2] - pick(c)[0]).alias(f"{c}__scale") for c in cols]), lay, "scaler")


def apply_scaler(df: DataFrame, params: DataFrame, lay: Layout, cols: list[str]) -> DataFrame:
    """(x - center) / scale on ``cols``; other columns stay.  The adaptive planner picks the join by real size."""
    joined = df.join(params, list(lay.keys), "left")
    scaled = {c: (F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale") for c in cols}
    return joined.withColumns(scaled).drop(*[f"{c}__{p}" for c in cols for p in ("center", "scale")])


def minmax_normalise(df: DataFrame, lay: Layout, col: str, out: str, softened: bool = False) -> DataFrame:
    """Scores to [0, 1] per series: zeros below a range of 1e-12, or (``softened``) range + 1e-12 in the denominator."""
    wide = with_totals(df, lay, {"_lo": F.min(col), "_hi": F.max(col)})
    span = F.col("_hi") - F.col("_lo")
    value = ((F.col(col) - F.col("_lo")) / (span + F.lit(1e-12)) if softened
             else F.when(span < 1e-12, F.lit(0.0)).otherwise((F.col(col) - F.col("_lo")) / span))
    return wide.withColumn(out, value).drop("_lo", "_hi")
