"""Sliding-window features: rows fall into panes once, windows merge the moments of their panes."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.functions import stats
from alarmspan.functions.timeparse import feature_name, pair_name, short_name
from alarmspan.layout import Layout
from alarmspan.operators.asof import asof_nearest

FeatureFn = Callable[[Column], Column]

# Feature names, their column prefixes and the ablation groups.
PREFIX = {"rms": "rms", "kurtosis": "kurt", "skewness": "skew", "crest_factor": "crest", "peak_to_peak": "p2p",
          "shape_factor": "shape", "variance": "var", "mean_abs": "mabs"}
GROUPS = {
    "rms_only": ("rms",),
    "kurtosis_only": ("kurtosis",),
    "time_domain": ("rms", "kurtosis", "skewness", "crest_factor", "peak_to_peak", "shape_factor", "variance"),
    "health_core": ("rms", "kurtosis", "crest_factor"),
    "all": ("rms", "kurtosis", "skewness", "crest_factor", "peak_to_peak", "shape_factor", "variance"),
}
ALL_FEATURES = GROUPS["all"]

BUILDERS: dict[str, FeatureFn] = {
    "rms": stats.rms, "kurtosis": stats.window_kurtosis, "skewness": stats.window_skewness,
    "crest_factor": stats.crest, "peak_to_peak": stats.peak_to_peak, "shape_factor": stats.shape_factor,
    "variance": F.var_pop, "mean_abs": stats.mean_abs,
}

# Features that windows merge from the moments of their panes.
MERGED = frozenset(PREFIX)

# Without whole series: rows of a stretch of windows merged in one task, and the least pane whose moments are less to hand
# on, once to meet and once to every window, than its rows.
_STRETCH_ROWS, _WIDE_PANE = 65_536, 10

# Windows of up to so many rows may be computed from those rows, each handed to the windows it lies in.
SHORT_ROWS = 64

# Beyond this many channels one aggregate expression per channel pair would exceed generated-code limits.
_PAIR_EXPRESSIONS = 12


def register_feature(name: str, prefix: str, build: FeatureFn) -> None:
    """Make a user-defined aggregate available to feature lists by name."""
    PREFIX[name] = prefix
    BUILDERS[name] = build


def window_step(window: int, overlap: float) -> int:
    return max(1, int(window * (1.0 - overlap)))


def to_windows(df: DataFrame, window: Column | int, step: Column | int) -> DataFrame:
    """One row per (row, window containing it), column ``w``; needs ``pos`` and ``n``.  Fan-out is window / step.

    ``window`` and ``step`` may be per-row columns, so rows of several sampling rates share one job.
    """
    win = (F.lit(window) if isinstance(window, int) else window).cast("double")
    stp = (F.lit(step) if isinstance(step, int) else step).cast("double")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - win + 1) / stp))
    count = F.floor((F.col("n") - win) / stp) + 1
    last = F.least(F.floor(F.col("pos") / stp), count - 1)
    ids = F.when((F.col("n") >= win) & (first <= last), F.sequence(first.cast("long"), last.cast("long")))
    return df.withColumn("w", F.explode(ids))


def common_divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive integers below 2^31."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    turn = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(46)), start, turn)["a"]


class Merged:
    """Moments of one channel over a window, from those of its panes: columns of an aggregate over the window's panes.

    Within a pane moments are about the pane's mean; here they are moved to the window's mean, so that nothing is ever a
    difference of large sums.  ``d`` is the distance between the two means, a column of every pane.
    """
    def __init__(self, i: int):
        n, v, d = (F.col(f"_{x}{i}") for x in "nvd")
        m2, m3, m4 = v * n, F.col(f"_s{i}") * v * F.sqrt(v) * n, (F.col(f"_k{i}") + 3.0) * v * v * n
        present = lambda c: F.sum(F.when(n > 0, c))
        self.count = F.sum(n)
        self.mean = F.max(f"_m{i}")
        self.variance = present(m2 + n * d * d) / self.count
        self.third = present(F.coalesce(m3, F.lit(0.0)) + 3 * d * m2 + n * d * d * d) / self.count
        self.fourth = present(F.coalesce(m4, F.lit(0.0)) + 4 * d * F.coalesce(m3, F.lit(0.0)) + 6 * d * d * m2 + n * d * d * d * d) / self.count
        self.highest, self.lowest = F.max(f"_h{i}"), F.min(f"_l{i}")
        self.mean_abs = present(F.col(f"_a{i}") * n) / self.count
        self.rms = F.sqrt(self.variance + self.mean * self.mean)
        self.largest = F.max(F.greatest(F.abs(f"_h{i}"), F.abs(f"_l{i}")))

    def _unless_empty(self, value: Column) -> Column:
        return F.when(self.count > 0, value)

    def feature(self, name: str) -> Column:
        sd = F.sqrt(self.variance)
        shrunk = sd / (sd + F.lit(stats.EPS))
        moment = lambda m, p: F.coalesce(F.try_divide(m, F.pow(sd, F.lit(p))) * F.pow(shrunk, F.lit(p)), F.lit(0.0))
        return self._unless_empty({
            "rms": self.rms, "variance": self.variance, "mean_abs": self.mean_abs, "peak_to_peak": self.highest - self.lowest,
            "kurtosis": moment(self.fourth, 4.0) - 3.0, "skewness": moment(self.third, 3.0),
            "crest_factor": self.largest / (self.rms + F.lit(stats.EPS)),
            "shape_factor": (self.rms + F.lit(stats.EPS)) / (self.mean_abs + F.lit(stats.EPS))}[name])


def _pane_moments(i: int, channel: str) -> dict[str, Column]:
    x = F.col(channel)
    return {f"_n{i}": F.count(x), f"_x{i}": F.avg(x), f"_v{i}": F.var_pop(x), f"_s{i}": F.skewness(x), f"_k{i}": F.kurtosis(x),
            f"_h{i}": F.max(x), f"_l{i}": F.min(x), f"_a{i}": F.avg(F.abs(x))}


def _total(x: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + of(v))


def short_windows(rows: DataFrame, lay: Layout, channels: Sequence[str], features: Sequence[str], stamps: Sequence[str],
                  keep: Sequence[str], longest: int) -> DataFrame:
    """Windows of at most ``longest`` rows from the rows themselves, in their order: sums row by row, moments of the
    deviations from the window's mean.  Needs ``pos``, ``n``, _win and _stp.

    A feature that hardly varies (the kurtosis of three rows, any shape of equal rows) is scaled by its rounding error, so
    a result then hangs on every step of the arithmetic.  This is the plain one, and the same whatever the layout.
    """
    group, dealt = list(lay.keys), rows
    if not lay.whole:
        group, dealt = [*lay.keys, "_s"], in_stretches(rows, lay).repartition(*lay.keys, "_s")
    back = Window.partitionBy(*group).orderBy("pos").rowsBetween(1 - longest, 0)
    w = (F.col("pos") + 1 - F.col("_win")) / F.col("_stp")
    ends = (w >= 0) & (w == F.floor(w))
    if "_s" in group:
        ends = ends & (F.floor(w / F.col("_per")) == F.col("_s"))
    held = dealt.withColumn("_rows", F.collect_list(F.struct(*stamps, *channels)).over(back)).where(ends)
    held = held.withColumns({"w": F.floor(w), "_rows": F.slice("_rows", -F.col("_win").cast("int"), F.col("_win").cast("int"))})
    centre = F.col("_rows")[F.floor(F.col("_win") / 2).cast("int")]
    eps, out = F.lit(stats.EPS), held.select(*lay.keys, "w", *[centre[c].alias(c) for c in stamps], *keep, "_rows")
    for i, c in enumerate(channels):
        x, d, n, mean, var, rms, size = (F.col(f"_{a}{i}") for a in ("x", "d", "n", "m", "v", "r", "a"))
        out = out.withColumn(f"_x{i}", F.filter(F.transform("_rows", lambda r: r[c].cast("double")), lambda v: v.isNotNull()))
        out = out.withColumn(f"_n{i}", F.nullif(F.size(x), F.lit(0)).cast("double"))
        out = out.withColumns({f"_m{i}": _total(x) / n, f"_r{i}": F.sqrt(_total(x, lambda v: v * v) / n), f"_a{i}": _total(x, F.abs) / n})
        out = out.withColumn(f"_d{i}", F.transform(x, lambda v: v - mean))
        out = out.withColumn(f"_v{i}", _total(d, lambda v: v * v) / n)
        flat, sd = F.array_max(x) == F.array_min(x), F.sqrt(var) + eps
        power = lambda k: _total(d, lambda v: F.pow(v, F.lit(k))) / n / F.pow(sd, F.lit(k))
        made = {"rms": rms, "variance": var, "mean_abs": size, "peak_to_peak": F.array_max(x) - F.array_min(x),
                "kurtosis": F.when(flat, F.lit(-3.0)).otherwise(power(4.0) - 3.0),
                "skewness": F.when(flat, F.lit(0.0)).otherwise(power(3.0)),
                "crest_factor": F.array_max(F.transform(x, F.abs)) / (rms + eps), "shape_factor": (rms + eps) / (size + eps)}
        out = out.withColumns({feature_name(PREFIX[f], c): F.when(n > 0, made[f]) for f in features})
    names = [feature_name(PREFIX[f], c) for c in channels for f in features]
    return out.select(*lay.keys, "w", *stamps, *keep, *names)


def rolling_features(df: DataFrame, lay: Layout, channels: Sequence[str], window: Column | int = 30,
                     overlap: float = 0.5, features: Sequence[str] = ALL_FEATURES, cross_channel: bool = True,
                     step: Column | int | None = None, keep: Sequence[str] = (), pane: Column | int | None = None,
                     longest: int | None = None) -> DataFrame:
    """One row per window, stamped with its centre row's timestamp (and ``hours_to_failure`` when present).

    A row is aggregated once, into its pane of gcd(window, step) rows; a window is the merge of its panes' moments, so
    only panes (rows / gcd of them) are handed to every window they lie in.  Unless series are whole or panes long, rows are
    dealt once to stretches of windows, which make and merge their panes themselves; only rows where two stretches meet are
    copied.  Needs ``pos`` and ``n``.  ``window``, ``step``
    and ``pane`` may be columns that are constant per series, so that several sampling rates share one job.  A registered
    feature of one's own has no moments to merge and is aggregated over the rows of each window.

    Pair correlations are over finite values: a null, NaN or infinity in either channel makes the window's correlation 0.
    Series shorter than one window give no rows; see :func:`short_series`.  ``keep`` lists columns constant per series.
    ``longest``: no window has more rows; up to ``SHORT_ROWS``, and without pairs or features of one's own, windows are then
    made by :func:`short_windows`.
    """
    keys = list(lay.keys)
    as_col = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    step = window_step(window, overlap) if step is None else step
    if pane is None:
        pane = math.gcd(window, step) if isinstance(window, int) and isinstance(step, int) else common_divisor(as_col(window), as_col(step))
    sizes = {"_win": as_col(window), "_stp": as_col(step), "_pane": as_col(pane)}
    own = [f for f in features if f not in MERGED]
    channels = list(channels)
    crossing = cross_channel and len(channels) > 1
    few = crossing and len(channels) <= _PAIR_EXPRESSIONS
    pairs = list(combinations(range(len(channels)), 2)) if few else []

    rows = df.withColumns(sizes).where(F.col("n") >= F.col("_win"))
    centre = F.col("pos") % F.col("_pane") == F.floor(F.col("_win") / 2) % F.col("_pane")
    stamps = [lay.order, *(["hours_to_failure"] if "hours_to_failure" in df.columns else [])]
    if longest and longest <= SHORT_ROWS and not own and not crossing:
        return short_windows(rows, lay, channels, features, stamps, keep, longest)
    aggs = {f"_at_{c}": F.max(F.when(centre, F.col(c))) for c in stamps}
    aggs |= {c: F.any_value(c) for c in dict.fromkeys([*keep, "n", *sizes])}
    for i, c in enumerate(channels):
        aggs |= _pane_moments(i, c)
        if few:
            aggs[f"_f{i}"] = F.count(stats.finite(F.col(c))) == F.count(F.lit(1))
    aggs |= {f"_c{i}_{j}": F.covar_pop(stats.finite(F.col(channels[i])), stats.finite(F.col(channels[j]))) for i, j in pairs}
    group, dealt = keys, rows
    if not lay.whole and not (isinstance(pane, int) and pane >= _WIDE_PANE):
        aggs["_per"] = F.any_value("_per")
        group, dealt = [*keys, "_s"], in_stretches(rows, lay).repartition(*keys, "_s")
    panes = dealt.groupBy(*group, F.floor(F.col("pos") / F.col("_pane")).alias("_p")).agg(*[c.alias(k) for k, c in aggs.items()])

    first = F.greatest(F.lit(0).cast("long"), F.ceil(((F.col("_p") + 1) * F.col("_pane") - F.col("_win")) / F.col("_stp")))
    last = F.least(F.floor(F.col("_p") * F.col("_pane") / F.col("_stp")), F.floor((F.col("n") - F.col("_win")) / F.col("_stp")))
    if "_s" in group:
        first = F.greatest(first, F.col("_s") * F.col("_per"))
        last = F.least(last, (F.col("_s") + 1) * F.col("_per") - 1)
    handed = panes.withColumn("w", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))
    whole = Window.partitionBy(*group, "w")
    if "_s" in group:  # in one order whatever the exchange did: sums do not change from run to run
        whole = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    handed = handed.withColumns({f"_m{i}": F.sum(F.when(F.col(f"_n{i}") > 0, F.col(f"_x{i}") * F.col(f"_n{i}"))).over(whole)
                                 / F.nullif(F.sum(f"_n{i}").over(whole), F.lit(0)) for i in range(len(channels))})
    handed = handed.withColumns({f"_d{i}": F.col(f"_x{i}") - F.col(f"_m{i}") for i in range(len(channels))})
    merged = [Merged(i) for i in range(len(channels))]
    middle = F.col("_p") == F.floor((F.col("w") * F.col("_stp") + F.floor(F.col("_win") / 2)) / F.col("_pane"))
    out = [F.max(F.when(middle, F.col(f"_at_{c}"))).alias(c) for c in stamps]
    out += [F.any_value(k).alias(k) for k in keep]
    out += [m.feature(f).alias(feature_name(PREFIX[f], c)) for m, c in zip(merged, channels) for f in features if f not in own]
    if crossing:
        out.append(sum((m.count * m.variance / F.nullif(m.count - 1, F.lit(0)) for m in merged[1:]),
                       merged[0].count * merged[0].variance / F.nullif(merged[0].count - 1, F.lit(0))).alias("cov_trace"))
    for i, j in pairs:
        n = F.col(f"_n{i}")
        shared = F.sum(n * (F.col(f"_c{i}_{j}") + F.col(f"_d{i}") * F.col(f"_d{j}"))) / merged[i].count
        r = F.try_divide(shared, F.sqrt(merged[i].variance) * F.sqrt(merged[j].variance))
        out.append(F.when(F.every(F.col(f"_f{i}") & F.col(f"_f{j}")), F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))
                   .alias(pair_name(channels[i], channels[j])))
    table = handed.groupBy(*group, "w").agg(*out).drop("_s")
    if crossing and not few:
        table = table.join(window_correlations(rows, lay, channels), [*keys, "w"])
    if own:
        spread = to_windows(rows, F.col("_win"), F.col("_stp"))
        mine = spread.groupBy(*keys, "w").agg(*[BUILDERS[f](F.col(c)).alias(feature_name(PREFIX[f], c)) for c in channels for f in own])
        names = [c for c in table.columns if c not in (*keys, "w")]
        lead = [c for c in names if c in (*stamps, *keep)]
        ordered = [feature_name(PREFIX[f], c) for c in channels for f in features]
        table = table.join(mine, [*keys, "w"]).select(*keys, "w", *lead, *ordered, *[c for c in names if c not in lead and c not in ordered])
    return table


def in_stretches(rows: DataFrame, lay: Layout) -> DataFrame:
    """Rows once for every stretch ``_s`` of ``_per`` windows they lie in; needs ``pos``, ``n``, _win and _stp.  All rows of a
    pane lie in the same stretches."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - F.col("_win") + 1) / F.col("_stp")))
    last = F.least(F.floor(F.col("pos") / F.col("_stp")), F.floor((F.col("n") - F.col("_win")) / F.col("_stp")))
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(min(lay.block_rows, _STRETCH_ROWS)) / F.col("_stp")))
    stretch = F.sequence(F.floor(first / F.col("_per")), F.floor(last / F.col("_per")))
    return rows.withColumn("_per", per).withColumn("_s", F.explode(F.when(first <= last, stretch)))


def window_correlations(rows: DataFrame, lay: Layout, channels: Sequence[str], windows: int = 64) -> DataFrame:
    """All channel-pair correlations of every window: (keys, w, one column a pair).

    Needs ``pos``, ``n`` and the sizes _win, _stp and _pane.  A task takes ``windows`` windows with the rows they span; only
    rows where two such stretches meet are copied.  Products are formed once a pane and moved to each window's mean.
    """
    pairs = list(combinations(range(len(channels)), 2))
    names = [pair_name(channels[i], channels[j]) for i, j in pairs]
    keys = list(lay.keys)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys]
    schema = ", ".join(fields + ["w bigint"] + [f"`{n}` double" for n in names])
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - F.col("_win") + 1) / F.col("_stp")))
    last = F.least(F.floor(F.col("pos") / F.col("_stp")), F.floor((F.col("n") - F.col("_win")) / F.col("_stp")))
    stretch = F.sequence(F.floor(first / windows), F.floor(last / windows))
    spread = rows.withColumn("_s", F.explode(F.when(first <= last, stretch)))

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        win, step, pane, n = (int(pdf[c].iloc[0]) for c in ("_win", "_stp", "_pane", "n"))
        w = np.arange(int(pdf["_s"].iloc[0]) * windows, min((int(pdf["_s"].iloc[0]) + 1) * windows, (n - win) // step + 1))
        x = pdf[list(channels)].to_numpy(dtype=float)
        base = int(pdf["pos"].iloc[0])
        x = x[:(int(w[-1]) * step + win - base) // pane * pane].reshape(-1, pane, x.shape[1])
        whole = np.isfinite(x).all(axis=1)
        x = np.where(whole[:, None, :], x, 0.0)
        means = x.mean(axis=1)
        off = x - means[:, None, :]
        products = np.matmul(off.transpose(0, 2, 1), off)
        at = ((w * step - base) // pane)[:, None] + np.arange(win // pane)
        mean = means[at].mean(axis=1)
        total = np.zeros((len(w), x.shape[2], x.shape[2]))
        for j in range(at.shape[1]):
            d = means[at[:, j]] - mean
            total += products[at[:, j]] + pane * d[:, :, None] * d[:, None, :]
        scale = np.sqrt(np.einsum("wii->wi", total))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = total / (scale[:, :, None] * scale[:, None, :])
        full = whole[at].all(axis=1)
        r = np.where(np.isfinite(r) & full[:, :, None] & full[:, None, :], r, 0.0)
        a, b = np.array(pairs).T
        return pd.concat([pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "w": w}), pd.DataFrame(r[:, a, b], columns=names)], axis=1)

    columns = [*keys, "_s", "pos", "n", "_win", "_stp", "_pane", *channels]
    return spread.select(*columns).groupBy(*keys, "_s").applyInPandas(correlate, schema)


def short_series(df: DataFrame, lay: Layout, window: int) -> DataFrame:
    """Series too short for one window, with their row count."""
    return df.groupBy(*lay.keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < window)


def feature_columns(channels: Sequence[str], features: Sequence[str] = ALL_FEATURES, cross_channel: bool = True) -> list[str]:
    names = [feature_name(PREFIX[f], c) for c in channels for f in features]
    if cross_channel and len(channels) > 1:
        names += [pair_name(a, b) for a, b in combinations(channels, 2)] + ["cov_trace"]
    return names


def ablation_long(df: DataFrame, lay: Layout, channels: Sequence[str]) -> DataFrame:
    """Every group's features as an array, tagged ``group``: windows are computed once and fanned out by projection."""
    lead = [*lay.keys, "w", lay.order]
    structs = []
    for group, feats in GROUPS.items():
        cols = feature_columns(channels, feats, cross_channel=(group == "all"))
        structs.append(F.struct(F.lit(group).alias("group"), F.array(*[F.col(c) for c in cols]).alias("features")))
    return df.select(*lead, F.explode(F.array(*structs)).alias("_g")).select(*lead, "_g.group", "_g.features")


def multiscale_features(df: DataFrame, lay: Layout, channels: Sequence[str], windows: Sequence[int],
                        overlap: float = 0.5, features: Sequence[str] = GROUPS["health_core"],
                        tolerance_seconds: float = 300.0) -> DataFrame:
    """Features per window size, suffixed ``_w<W>``, joined nearest in time onto the grid of the last size listed."""
    base = [feature_name(PREFIX[f], c) for c in channels for f in features]
    scales = {}
    for size in windows:
        table = rolling_features(df, lay, channels, size, overlap, features, cross_channel=False)
        renamed = [F.col(c).alias(f"{c}_w{size}") for c in base]
        extra = ["hours_to_failure"] if size == windows[-1] and "hours_to_failure" in table.columns else []
        scales[size] = table.select(*lay.keys, *(["w"] if size == windows[-1] else []), lay.order, *renamed, *extra)
    fused = scales[windows[-1]]
    for size in windows[:-1]:
        fused = asof_nearest(fused, scales[size], lay, [f"{c}_w{size}" for c in base], tolerance_seconds)
    return fused


def snapshot_statistics(df: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """Statistics of one raw snapshot per channel: one partial aggregate over all samples."""
    return df.groupBy(*keys).agg(
        stats.rms(x).alias("rms"), stats.snapshot_kurtosis(x).alias("kurt"), stats.snapshot_skewness(x).alias("skew"),
        stats.peak_to_peak(x).alias("p2p"), stats.crest(x).alias("crest"), F.var_pop(x).alias("var"))


def design_matrix(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one array column; their names stay with the schema as column metadata."""
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(out, vector.alias(out, metadata={"names": list(cols)}))


def sequences(df: DataFrame, lay: Layout, length: int, features: str = "features") -> DataFrame:
    """Overlapping runs of ``length`` feature rows ending at each row, flattened; needs ``pos``.  n rows give
    n - length + 1 sequences."""
    from alarmspan.operators.ordered import rolling
    gather = {"sequence": lambda w: F.flatten(F.collect_list(features).over(w.rowsBetween(-(length - 1), 0)))}
    return rolling(df, lay, length - 1, 0, [gather]).where(F.col("pos") >= length - 1)
