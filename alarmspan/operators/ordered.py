"""Order-dependent building blocks: row position, rolling frames, carried values, linear scans, persistent runs.

Each has two plans with equal results.  ``layout.whole``: windows partitioned by the series key, all sharing one
exchange.  Otherwise: blocks of ``layout.block_rows`` rows, with halo rows or small per-block summaries in between.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.layout import Layout

# exp(600) is near 1e260: powers of the decay stay inside double range over one scan block.
_SCAN_RANGE = 600.0
# exp(-100): what a block no longer hands on.
_FORGET = 100.0


def with_position(df: DataFrame, lay: Layout, pos: str = "pos", n: str = "n", tie: Sequence[str] = ()) -> DataFrame:
    """Zero-based row position inside the series by time (then ``tie``), and the row count of the series."""
    keys = list(lay.keys)
    if lay.whole:
        by_time = Window.partitionBy(*keys).orderBy(lay.order, *tie)
        df = df if lay.tasks is None else df.repartition(lay.tasks, *keys)
        return (df.withColumn(pos, (F.row_number().over(by_time) - 1).cast("long"))
                  .withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    cell = F.floor(F.unix_micros(F.col(lay.order)) / F.lit(lay.cell_us))
    celled = df.withColumn("_cell", cell)
    counts = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    so_far = Window.partitionBy(*keys).orderBy("_cell")
    offsets = counts.select(
        *keys, "_cell",
        (F.sum("_in_cell").over(so_far) - F.col("_in_cell")).alias("_offset"),
        F.sum("_in_cell").over(Window.partitionBy(*keys)).alias(n))
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(lay.order, *tie)
    return (celled.join(offsets, [*keys, "_cell"])
                  .withColumn(pos, (F.col("_offset") + F.row_number().over(in_cell) - 1).cast("long"))
                  .drop("_cell", "_offset"))


def block_of(lay: Layout, pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / F.lit(lay.block_rows))


def rolling(df: DataFrame, lay: Layout, before: int, after: int,
            steps: Sequence[dict[str, Callable]], pos: str = "pos") -> DataFrame:
    """Add columns computed over row frames that reach ``before`` rows back and ``after`` rows ahead in total.

    ``steps`` are applied in turn, so a later step may use an earlier one's column; each value builds a column from
    the ordered window it is given.  In block form the rows within reach of a block edge are copied to that block.
    """
    keys = list(lay.keys)

    def apply(frame: DataFrame, window) -> DataFrame:
        for step in steps:
            frame = frame.withColumns({name: build(window) for name, build in step.items()})
        return frame

    if lay.whole:
        return apply(df, Window.partitionBy(*keys).orderBy(pos))
    size = F.lit(lay.block_rows)
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - F.lit(after)) / size))
    last = F.floor((F.col(pos) + F.lit(before)) / size)
    spread = df.withColumn("_block", F.explode(F.sequence(first, last)))
    done = apply(spread, Window.partitionBy(*keys, "_block").orderBy(pos))
    return done.where(F.col("_block") == block_of(lay, pos)).drop("_block")


def trailing(df: DataFrame, lay: Layout, window: int, parts: dict[str, Column], pos: str = "pos") -> DataFrame:
    """Aggregates over the last ``window`` rows in two pieces that never overlap, in a time that does not depend on it.

    The series is cut every ``window`` rows.  A trailing window is the rows of its own piece up to the row, and the end of
    the piece before from ``window`` - 1 rows back.  Both are running aggregates, one in each direction, which Spark
    updates by a row at a time; nothing is ever taken out again, so no digits are lost.  Adds ``_new_<name>`` and
    ``_old_<name>`` (null where the window does not reach back) for the caller to merge.
    """
    cut = [*lay.keys, "_cut"]
    ahead = Window.partitionBy(*cut).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*cut).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    pieces = df.withColumn("_cut", F.floor(F.col(pos) / F.lit(window)))
    pieces = pieces.withColumns({f"_new_{k}": c.over(ahead) for k, c in parts.items()}
                                | {f"_end_{k}": c.over(back) for k, c in parts.items()})
    reaches = (F.col(pos) + 1) % F.lit(window) != 0
    met = {f"_old_{k}": lambda w, k=k: F.when(reaches, F.lag(f"_end_{k}", window - 1).over(w)) for k in parts}
    return rolling(pieces, lay, window - 1, 0, [met], pos).drop("_cut", *[f"_end_{k}" for k in parts])


def drop_pieces(df: DataFrame, parts) -> DataFrame:
    return df.drop(*[f"_{side}_{k}" for side in ("new", "old") for k in parts])


def trailing_mean(df: DataFrame, lay: Layout, value: Column, window: int, out: str, pos: str = "pos", full_only: bool = False) -> DataFrame:
    """Mean of the values present among the last ``window`` rows; only where all are present when ``full_only``."""
    parts = {"sum": F.sum(value.cast("double")), "count": F.count(value)}
    rows = trailing(df, lay, window, parts, pos)
    both = lambda k, kind: F.coalesce(f"_new_{k}", F.lit(0).cast(kind)) + F.coalesce(f"_old_{k}", F.lit(0).cast(kind))
    mean = F.try_divide(both("sum", "double"), both("count", "double"))
    return drop_pieces(rows.withColumn(out, F.when(both("count", "long") == window, mean) if full_only else mean), parts)


def trailing_moments(df: DataFrame, lay: Layout, window: int, values: dict[str, Column], pairs: Sequence[tuple[str, str]] = (),
                     pos: str = "pos") -> DataFrame:
    """Counts, population variances and covariances of values over the last ``window`` rows: ``_count_<name>``,
    ``_var_<name>``, ``_cov_<a>_<b>``.  A covariance is over rows where both are present, as they must be throughout."""
    parts = {}
    for name, value in values.items():
        x = value.cast("double")
        parts |= {f"n_{name}": F.count(x), f"m_{name}": F.avg(x), f"v_{name}": F.var_pop(x)}
    parts |= {f"c_{a}_{b}": F.covar_pop(values[a].cast("double"), values[b].cast("double")) for a, b in pairs}
    rows = trailing(df, lay, window, parts, pos)
    n = lambda side, name: F.coalesce(f"_{side}_n_{name}", F.lit(0)).cast("double")
    piece = lambda side, kind, name: F.coalesce(f"_{side}_{kind}_{name}", F.lit(0.0))
    total = lambda name: n("new", name) + n("old", name)
    apart = lambda name: F.when((n("new", name) > 0) & (n("old", name) > 0), piece("new", "m", name) - piece("old", "m", name)).otherwise(F.lit(0.0))

    def merged(kind: str, name: str, of: str, product: Column) -> Column:
        own = n("new", of) * piece("new", kind, name) + n("old", of) * piece("old", kind, name)
        return F.try_divide(own + F.coalesce(F.try_divide(product * n("new", of) * n("old", of), total(of)), F.lit(0.0)), total(of))
    out = {f"_count_{name}": total(name).cast("long") for name in values}
    out |= {f"_var_{name}": merged("v", name, name, apart(name) * apart(name)) for name in values}
    out |= {f"_cov_{a}_{b}": merged("c", f"{a}_{b}", a, apart(a) * apart(b)) for a, b in pairs}
    return drop_pieces(rows.withColumns(out), parts)


def carry(df: DataFrame, lay: Layout, previous: dict[str, Column] | None = None,
          following: dict[str, Column] | None = None, pos: str = "pos") -> DataFrame:
    """Latest non-null value at or before each row (``previous``) / earliest at or after it (``following``)."""
    keys = list(lay.keys)
    previous, following = previous or {}, following or {}
    back = {f"_p{i}": c for i, c in enumerate(previous.values())}
    ahead = {f"_f{i}": c for i, c in enumerate(following.values())}
    out = df.withColumns({**back, **ahead})
    part = keys
    if not lay.whole:
        out = out.withColumn("_block", block_of(lay, pos))
        part = [*keys, "_block"]
    upto = Window.partitionBy(*part).orderBy(F.col(pos)).rowsBetween(Window.unboundedPreceding, 0)
    # Reverse order rather than an "unbounded following" frame, which would rescan the rest for each row.
    onward = Window.partitionBy(*part).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = {name: F.last(tmp, ignorenulls=True).over(upto) for name, tmp in zip(previous, back)}
    local |= {name: F.last(tmp, ignorenulls=True).over(onward) for name, tmp in zip(following, ahead)}
    if lay.whole:
        return out.withColumns(local).drop(*back, *ahead)
    edges = out.groupBy(*part).agg(
        *[F.max_by(tmp, F.when(F.col(tmp).isNotNull(), F.col(pos))).alias(f"_e{tmp}") for tmp in back],
        *[F.min_by(tmp, F.when(F.col(tmp).isNotNull(), F.col(pos))).alias(f"_e{tmp}") for tmp in ahead])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *part,
        *[F.last(f"_e{tmp}", ignorenulls=True).over(earlier).alias(f"_c{tmp}") for tmp in back],
        *[F.last(f"_e{tmp}", ignorenulls=True).over(later).alias(f"_c{tmp}") for tmp in ahead])
    out = out.withColumns(local).join(edges, part)
    carried = {name: F.coalesce(F.col(name), F.col(f"_c{tmp}"))
               for name, tmp in [*zip(previous, back), *zip(following, ahead)]}
    return out.withColumns(carried).drop("_block", *back, *ahead, *[f"_c{t}" for t in [*back, *ahead]])


def with_totals(df: DataFrame, lay: Layout, totals: dict[str, Column]) -> DataFrame:
    """Add whole-series aggregates to every row.

    Whole layout: a window over the series, no extra exchange.  Otherwise an aggregate (map-side combined), written, so that
    its size is known before the rows are read again: the planner ships a small one to the rows where they are.  A larger
    one is joined back by series and time cell: one copy of the totals per cell, so that a hot series is spread over its
    cells, and no later step can take its rows for gathered by series.
    """
    from alarmspan.session import cut_lineage, ships
    keys = list(lay.keys)
    if lay.whole:
        return df.withColumns({k: c.over(Window.partitionBy(*keys)) for k, c in totals.items()})
    table = cut_lineage(df.groupBy(*keys).agg(*[c.alias(k) for k, c in totals.items()]), "totals")
    if ships(table):
        return df.join(table, keys)
    cell = F.coalesce(F.floor(F.unix_micros(F.col(lay.order)) / F.lit(lay.cell_us)), F.lit(0))
    celled = df.withColumn("_total_cell", cell)
    copies = celled.select(*keys, "_total_cell").distinct().join(table, keys)
    return celled.join(copies, [*keys, "_total_cell"]).drop("_total_cell")


def linear_scan(df: DataFrame, lay: Layout, value: Column, decay: float, seed: Column, out: str,
                pos: str = "pos") -> DataFrame:
    """x_t = value_t + decay * x_(t-1) with x_(-1) = seed (constant per series), without a sequential pass.

    Inside a block of L rows the closed form decay^i * sum(value_j * decay^-j) is a running sum; L keeps its powers
    in double range.  A block's last value reaches j blocks on scaled by decay^(L*j), so each block summary is sent
    to the few blocks it still matters for (until e^-100, far below double precision) and summed there.
    """
    keys = list(lay.keys)
    if decay <= 0.0:
        return df.withColumn(out, value)
    length = max(1, min(int(_SCAN_RANGE / -math.log(decay)), lay.block_rows))
    i = F.col(pos) % F.lit(length)
    power = F.pow(F.lit(decay), i.cast("double"))
    base = df.withColumns({"_v": value.cast("double"), "_seed": seed.cast("double")})
    if lay.max_rows is not None and lay.max_rows <= length:
        run = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        local = F.sum(F.col("_v") / power).over(run) * power
        return base.withColumn(out, local + power * F.lit(decay) * F.col("_seed")).drop("_v", "_seed")
    base = base.withColumn("_m", F.floor(F.col(pos) / F.lit(length)))
    run = Window.partitionBy(*keys, "_m").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_local", F.sum(F.col("_v") / power).over(run) * power)
    blocks = base.groupBy(*keys, "_m").agg(F.max_by("_local", pos).alias("_b"), F.any_value("_seed").alias("_s"))
    block_decay = decay ** length
    reach = math.ceil(_FORGET / (-math.log(decay) * length))
    step = F.explode(F.sequence(F.lit(0), F.lit(reach)))
    sent = blocks.select(*keys, "_m", "_b", "_s", step.alias("_j"))
    fade = F.pow(F.lit(block_decay), F.col("_j").cast("double"))
    sent = sent.select(*keys, F.explode(F.array(
        F.struct((F.col("_m") + 1 + F.col("_j")).alias("to"), (F.col("_b") * fade).alias("x")),
        F.struct(F.when(F.col("_m") == 0, F.col("_j")).cast("long").alias("to"), (F.col("_s") * fade).alias("x"))
    )).alias("_c"))
    received = (sent.where(F.col("_c.to").isNotNull()).groupBy(*keys, F.col("_c.to").alias("_m"))
                    .agg(F.sum("_c.x").alias("_in")))
    return (base.join(received, [*keys, "_m"])
                .withColumn(out, F.col("_local") + power * F.lit(decay) * F.col("_in"))
                .drop("_v", "_seed", "_m", "_local", "_in"))


def ewma(df: DataFrame, lay: Layout, value: Column, lam: float, seed: Column, out: str, pos: str = "pos") -> DataFrame:
    """Exponentially weighted mean e_t = lam * v_t + (1 - lam) * e_(t-1), e_(-1) = seed."""
    return linear_scan(df, lay, value * F.lit(lam), 1.0 - lam, seed, out, pos)


def run_length(df: DataFrame, lay: Layout, hit: Column, out: str, pos: str = "pos") -> DataFrame:
    """Length of the run of consecutive hits a row lies in; 0 where there is no hit."""
    keys = list(lay.keys)
    base = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    if lay.whole:
        order = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        island = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(order)
        same = Window.partitionBy(*keys, "_island")
        return (base.withColumn("_island", island)
                    .withColumn(out, F.when(F.col("_hit"), F.count(F.when(F.col("_hit"), 1)).over(same))
                                      .otherwise(F.lit(0)).cast("long"))
                    .drop("_hit", "_island"))
    miss_at = F.when(~F.col("_hit"), F.col(pos))
    base = with_totals(base, lay, {"_rows": F.max(F.col(pos) + 1)})
    base = carry(base, lay, {"_before": miss_at}, {"_after": miss_at}, pos)
    length = F.coalesce(F.col("_after"), F.col("_rows")) - F.coalesce(F.col("_before"), F.lit(-1)) - 1
    return (base.withColumn(out, F.when(F.col("_hit"), length).otherwise(F.lit(0)).cast("long"))
                .drop("_hit", "_before", "_after", "_rows"))


def settle(df: DataFrame, lay: Layout, label: str = "rows") -> DataFrame:
    """Block plans read their input twice (rows and summaries); write it once so that chains do not multiply.

    The whole layout has no such second reading and stays lazy.
    """
    from alarmspan.session import cut_lineage
    return df if lay.whole else cut_lineage(df, label)
