"""Channel-pair correlation, lead-lag, rolling correlation and overlays."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.functions.stats import EPS, pearson
from alarmspan.functions.tails import pearson_p
from alarmspan.layout import Layout
from alarmspan.operators.ordered import settle, trailing_moments, with_position, with_totals


# Pairs of a lag up to which its moments are summed on their own.
FEW_PAIRS = 512


def channel_pairs(df: DataFrame, lay: Layout, channels: Sequence[str]) -> DataFrame:
    """Rows where both channels of a pair are present: (keys, ts, chan_a, chan_b, a, b).  The fan-out is the pair count."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("chan_a"), F.lit(b).alias("chan_b"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        for a, b in combinations(channels, 2)]))
    lead = [*lay.keys, lay.order]
    pairs = df.select(*lead, cells.alias("_p")).select(*lead, "_p.*")
    return pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def pair_layout(lay: Layout) -> Layout:
    return lay.by("chan_a", "chan_b")


def strength(r: Column, cuts: tuple[float, float] = (0.4, 0.7), names=("Weak", "Moderate", "Strong")) -> Column:
    size = F.abs(r)
    return F.when(size > cuts[1], names[2]).when(size > cuts[0], names[1]).otherwise(names[0])


def direction(r: Column) -> Column:
    return F.when(r > 0, "Positive").otherwise("Negative")


def pair_correlation(pairs: DataFrame, lay: Layout, min_rows: int = 5) -> DataFrame:
    """Pearson r, OLS line of b on a, labels and pair count, for pairs with enough common rows."""
    a, b = F.col("a"), F.col("b")
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    out = pairs.groupBy(*lay.keys).agg(F.count(F.lit(1)).alias("n"), pearson(a, b).alias("r"), slope.alias("slope"),
                                       (F.avg(b) - slope * F.avg(a)).alias("intercept"))
    return out.where(F.col("n") >= min_rows).withColumns({"strength": strength(F.col("r")), "direction": direction(F.col("r"))})


def with_p_value(table: DataFrame) -> DataFrame:
    """Two-sided p-value on the result table (one row per pair)."""
    return table.withColumn("p_value", pearson_p(F.col("r"), F.col("n")))


def lagged_correlation(pairs: DataFrame, lay: Layout, max_lag: int = 20, chunk_rows: int = 8_192) -> DataFrame:
    """r between a[t + lag] and b[t] for lags -L..L over the pair's common rows.

    Overlap-save: a chunk of b meets the same chunk of a with L more rows at either end, and one transform gives its
    products at all lags.  What leaves a chunk are the counts, means and centred moments of its 2L + 1 lags, merged about
    each lag's own mean; rows are copied at chunk edges only.
    """
    keys = list(lay.keys)
    rows = settle(with_position(pairs, lay), lay, "pairs")
    size = max(chunk_rows, max_lag)
    chunks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - max_lag) / size)), F.floor((F.col("pos") + max_lag) / size))
    fields = {f.name: f for f in rows.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k].dataType.simpleString()}" for k in keys]
                       + ["lag int, rows bigint, total bigint, ma double, mb double, va double, vb double, c double"])
    lags = np.arange(-max_lag, max_lag + 1)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        chunk, at = int(pdf["_chunk"].iloc[0]), pdf["pos"].to_numpy()
        own = np.flatnonzero(at // size == chunk)
        if not len(own):
            return pd.DataFrame(columns=[*keys, "lag", "rows", "total", "ma", "mb", "va", "vb", "c"])
        moments = lag_moments(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), int(own[0]), int(own[-1]) + 1, lags)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "lag": lags, "rows": moments[0].astype(int), "total": int(pdf["n"].iloc[0]),
                             **dict(zip(("ma", "mb", "va", "vb", "c"), moments[1:]))})

    spread = rows.select(*keys, "pos", "n", "a", "b", F.explode(chunks).alias("_chunk"))
    parts = spread.groupBy(*keys, "_chunk").applyInPandas(products, schema)
    same = Window.partitionBy(*keys, "lag")
    mean = lambda m: F.try_divide(F.sum(F.col(m) * F.col("rows")).over(same), F.sum("rows").over(same))
    parts = parts.withColumns({"_da": F.col("ma") - mean("ma"), "_db": F.col("mb") - mean("mb")})
    merged = lambda own, x, y: F.sum(F.col(own) + F.col("rows") * F.col(x) * F.col(y))
    r = F.try_divide(merged("c", "_da", "_db"), F.sqrt(merged("va", "_da", "_da")) * F.sqrt(merged("vb", "_db", "_db")))
    table = parts.groupBy(*keys, "lag").agg(F.coalesce(r, F.lit(0.0)).alias("r"), F.max("total").alias("n"))
    return table.withColumn("bound", F.lit(1.96) / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")))


def lag_moments(a: np.ndarray, b: np.ndarray, start: int, end: int, lags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per lag: pairs (a[t + lag], b[t]) with t in [start, end), means of both, centred sums of squares and of products.

    Values are taken off their first, so that constant stretches have no spread at all, and sums of any stretch are
    differences of two running sums.
    """
    first_a, first_b = a[0], b[start]
    x, y = a - first_a, b[start:end] - first_b
    low = np.clip(start + lags, 0, len(x))
    high = np.clip(end + lags, 0, len(x))
    high = np.maximum(low, high)
    n = (high - low).astype(float)
    size = 1 << int(np.ceil(np.log2(len(x) + len(y))))
    crossed = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)[(start + lags) % size]
    running = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    sum_x, sum_xx = ((r := running(v))[high] - r[low] for v in (x, x * x))
    first_y = np.where(n > 0, low - lags - start, 0)
    sum_y, sum_yy = ((r := running(v))[first_y + n.astype(int)] - r[first_y] for v in (y, y * y))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_x, mean_y = np.where(n > 0, sum_x / n, 0.0), np.where(n > 0, sum_y / n, 0.0)
    # A transform leaves rounding where the exact product is zero.
    crossed = np.where((sum_xx == 0) | (sum_yy == 0), 0.0, crossed)
    out = np.stack([n, first_a + mean_x, first_b + mean_y, np.maximum(sum_xx - n * mean_x ** 2, 0.0), np.maximum(sum_yy - n * mean_y ** 2, 0.0),
                    crossed - n * mean_x * mean_y])
    # Few pairs, as at the ends of a series: what their sums share with the rest of the chunk would drown them.
    for k in np.flatnonzero((n > 0) & (n <= FEW_PAIRS)):
        u, w = x[low[k]:high[k]], y[first_y[k]:first_y[k] + int(n[k])]
        u_off, w_off = u - u.mean(), w - w.mean()
        out[1:, k] = first_a + u.mean(), first_b + w.mean(), u_off @ u_off, w_off @ w_off, u_off @ w_off
    return tuple(out)


def lead_lag(table: DataFrame, lay: Layout) -> DataFrame:
    """Best lag (first maximum of |r|) and who leads: at a positive lag b moves first."""
    best = table.groupBy(*lay.keys).agg(F.min_by(F.struct("lag", "r"), F.struct(-F.round(F.abs("r"), 12), F.col("lag"))).alias("_b"))
    lag = F.col("_b.lag")
    leader = F.when(lag == 0, "simultaneous").when(lag > 0, F.col("chan_b")).otherwise(F.col("chan_a"))
    return best.select(*lay.keys, lag.alias("best_lag"), F.col("_b.r").alias("best_r"), leader.alias("leader"))


def rolling_correlation(pairs: DataFrame, lay: Layout, window: int = 360) -> DataFrame:
    """Trailing correlation over ``window`` common rows; null while undefined."""
    rows = settle(with_position(pairs, lay), lay, "pairs")
    moments = trailing_moments(rows, lay, window, {"a": F.col("a"), "b": F.col("b")}, [("a", "b")])
    r = F.try_divide(F.col("_cov_a_b"), F.sqrt("_var_a") * F.sqrt("_var_b"))
    return moments.withColumn("rolling_r", r).drop("_count_a", "_count_b", "_var_a", "_var_b", "_cov_a_b")


def overlay(pairs: DataFrame, lay: Layout) -> DataFrame:
    """Both channels as z-scores and the progress of each row from 0 to 1 along the pair."""
    rows = settle(with_position(pairs, lay), lay, "pairs")
    wide = with_totals(rows, lay, {"_ma": F.avg("a"), "_sa": F.stddev_pop("a"), "_mb": F.avg("b"), "_sb": F.stddev_pop("b")})
    z = lambda x: (F.col(x) - F.col(f"_m{x}")) / (F.col(f"_s{x}") + F.lit(EPS))
    progress = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return wide.withColumns({"za": z("a"), "zb": z("b"), "progress": progress}).drop("_ma", "_sa", "_mb", "_sb")


def influence_summary(corr: DataFrame, best: DataFrame, lay: Layout) -> DataFrame:
    """Facts about a channel pair, and a note made of them: instant r with its grade, the best lagged r, who is ahead."""
    t = corr.join(best, list(lay.keys))
    grade = strength(F.col("r"), (0.3, 0.6), ("weak", "moderate", "strong"))
    t = t.withColumns({"grade": F.concat_ws(" ", grade, F.lower(direction(F.col("r")))),
                       "influence": F.coalesce(F.abs("best_r") > 0.5, F.lit(False)),
                       "lag_rows": F.abs("best_lag").cast("long")})
    note = F.concat(F.col("chan_a"), F.lit("/"), F.col("chan_b"), F.lit(": "), F.col("grade"),
                    F.when(F.col("lag_rows") == 0, F.lit(", no lag"))
                     .otherwise(F.concat(F.lit(", "), F.col("leader"), F.lit(" ahead by "), F.col("lag_rows").cast("string"))),
                    F.when(F.col("influence"), F.lit(", linked")).otherwise(F.lit("")))
    return t.select(*lay.keys, "r", "grade", "leader", "lag_rows", "best_r", "influence", note.alias("note"))
