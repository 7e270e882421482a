"""Isolation forest: trees grown from bounded draws, one task per tree; scores and attributions per row chunk."""
from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.detectors.base import Detector, register_detector
from alarmspan.detectors.chunks import matrix_of, per_chunk, spread, with_chunk
from alarmspan.layout import Layout
from alarmspan.session import cut_lineage

_EULER = 0.5772156649015329
_TREES_PER_GROUP = 8


def expected_depth(n) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    return np.where(n > 2, 2.0 * (np.log(big - 1.0) + _EULER) - 2.0 * (big - 1.0) / big, np.where(n == 2, 1.0, 0.0))


def prime_below(n: int) -> int:
    """The largest prime up to ``n`` (at least 2)."""
    def prime(m: int) -> bool:
        if m < 4:
            return m > 1
        if m % 2 == 0:
            return False
        d, r = m - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):  # decides every 64-bit number
            if a % m == 0:
                continue
            x = pow(a, d, m)
            if x in (1, m - 1):
                continue
            for _ in range(r - 1):
                x = x * x % m
                if x == m - 1:
                    break
            else:
                return False
        return True
    while not prime(n):
        n -= 1
    return n


def draw_rows(train: DataFrame, lay: Layout, n_trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` distinct training rows per (series, tree), or all of them where there are no more.

    Draw i of a tree is (a * i + b) modulo the largest prime up to the series' length, moved on by c modulo the length:
    different draws of a tree are different rows, and any row can come.  a, b and c are hashes of the series, the tree and
    the seed.  So a draw is worked out by itself: as many rows as are drawn, nothing to sort out, for a series of any length.
    """
    keys = list(lay.keys)
    prime = F.pandas_udf(lambda n: n.map(lambda x: prime_below(max(2, int(x)))), "long")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", prime("_n"))
    part = lambda i: F.xxhash64(F.lit(seed), F.lit(i), F.col("tree"), *keys)
    trees = sizes.select(*keys, "_n", "_p", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")).withColumns(
        {"_a": F.pmod(part(1), F.col("_p") - 1) + 1, "_b": F.pmod(part(2), F.col("_p")), "_c": F.pmod(part(3), F.col("_n"))})
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(sample).cast("long")) - 1))
    drawn = trees.withColumn("_i", i)
    # i is below the sample size, so the product stays within 64 bits up to 2^53 rows.
    pos = F.when(F.col("_n") <= sample, F.col("_i")).otherwise(
        ((F.col("_a") * F.col("_i") + F.col("_b")) % F.col("_p") + F.col("_c")) % F.col("_n"))
    return train.join(drawn.select(*keys, "tree", pos.alias("pos")), [*keys, "pos"])


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """Random axis-parallel splits of a small matrix; node lists with child indices (-1 at leaves)."""
    tree = {"feature": [], "cut": [], "left": [], "right": [], "cover": [], "depth": []}
    chance = rng.random((2 * len(x) + 2, 2)).tolist()
    pending = [(np.arange(len(x)), 0, -1, "")]
    while pending:
        rows, depth, parent, side = pending.pop()
        node = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = node
        f, cut = -1, 0.0
        if depth < limit and len(rows) > 1:
            sub = x[rows]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            open_features = np.flatnonzero(hi > lo)
            if len(open_features):
                pick, place = chance[node]
                f = int(open_features[int(pick * len(open_features))])
                cut = float(lo[f] + place * (hi[f] - lo[f]))
                if cut >= hi[f]:
                    cut = float(lo[f])
        for name, value in (("feature", f), ("cut", cut), ("left", -1), ("right", -1),
                            ("cover", float(len(rows))), ("depth", float(depth))):
            tree[name].append(value)
        if f >= 0:
            below = sub[:, f] <= cut
            pending.append((rows[~below], depth + 1, node, "right"))
            pending.append((rows[below], depth + 1, node, "left"))
    return tree


def fit_forest(train: DataFrame, lay: Layout, n_trees: int = 200, sample: int = 256, seed: int = 42,
               features: str = "features") -> DataFrame:
    """Node table: one row per (series, tree) with its nodes as arrays and the sample size it was grown from."""
    keys = list(lay.keys)
    drawn = draw_rows(train.select(*keys, "pos", features), lay, n_trees, sample, seed)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.schema.fields if f.name in keys)
    schema = (f"{head}, tree int, psi int, feature array<int>, cut array<double>, left array<int>, right array<int>, "
              "cover array<double>, depth array<double>")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        lead = {k: pdf[k].iloc[0] for k in keys}
        tag = zlib.crc32("|".join(str(v) for v in lead.values()).encode())
        x, tree_of, pos = matrix_of(pdf[features]), pdf["tree"].to_numpy(), pdf["pos"].to_numpy()
        made = []
        for tree_id in np.unique(tree_of):
            mine = np.flatnonzero(tree_of == tree_id)
            part = x[mine[np.argsort(pos[mine])]]
            depth = max(1, math.ceil(math.log2(max(len(part), 2))))
            made.append({**lead, "tree": int(tree_id), "psi": len(part), **_grow(part, np.random.default_rng([seed, int(tree_id), tag]), depth)})
        return pd.DataFrame(made)

    # A few trees per group: still a bounded matrix, with less overhead per Python call.
    bundled = drawn.withColumn("_bundle", F.floor(F.col("tree") / F.lit(_TREES_PER_GROUP)))
    return spread(bundled, *keys, "_bundle").groupBy(*keys, "_bundle").applyInPandas(grow, schema)


def packed_forest(trees: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """All trees' nodes in one set of arrays: roots, feature, cut, the children below and above, path length, levels.

    A leaf is its own child, so rows that have arrived stay where they are.
    """
    sizes = np.array([len(f) for f in trees["feature"]])
    roots = np.cumsum(sizes) - sizes
    joined = lambda name, kind: np.concatenate([np.asarray(v, dtype=kind) for v in trees[name]])
    feature, cut, depth, cover = joined("feature", int), joined("cut", float), joined("depth", float), joined("cover", float)
    own, first = np.arange(len(feature)), np.repeat(roots, sizes)
    leaf = feature < 0
    below, above = (np.where(leaf, own, joined(side, int) + first) for side in ("left", "right"))
    return roots, np.where(leaf, 0, feature), cut, below, above, depth + expected_depth(cover), int(depth.max(initial=0))


def _mean_depth(x: np.ndarray, trees: pd.DataFrame, block: int = 2048, few: int = 16) -> np.ndarray:
    """``block`` rows go down ``few`` trees at a time: their nodes and those of the trees stay in the processor's cache."""
    roots, feature, cut, below, above, length, levels = packed_forest(trees)
    child = np.stack([above, below], axis=1).ravel()
    out = np.empty(len(x))
    for start in range(0, len(x), block):
        part = x[start:start + block]
        flat, row = part.ravel(), np.arange(len(part)) * part.shape[1]
        total = np.zeros(len(part))
        for first in range(0, len(roots), few):
            node = np.repeat(roots[first:first + few, None], len(part), axis=1)
            for _ in range(levels):
                node = child.take(2 * node + (flat.take(row + feature.take(node)) <= cut.take(node)))
            for path in length.take(node):
                total += path
        out[start:start + block] = total / len(roots)
    return out


def isolation_forest(features: str = "features", n_estimators: int = 200, random_state: int = 42, max_samples: int = 256,
                     contamination: str = "auto") -> Detector:
    """Score 2^(-mean depth / c(psi)) - 1/2: above zero is more isolated than average."""
    def fit(train: DataFrame, lay: Layout) -> DataFrame:
        return cut_lineage(fit_forest(train, lay, n_estimators, max_samples, random_state, features), "forest")

    def compute(rows: pd.DataFrame, trees: pd.DataFrame) -> dict:
        scale = max(float(expected_depth(trees["psi"].max())), 1e-12)
        return {"score": np.power(2.0, -_mean_depth(matrix_of(rows[features]), trees) / scale) - 0.5}

    def score(rows: DataFrame, params: DataFrame, lay: Layout) -> DataFrame:
        return per_chunk(rows, params, lay.keys, compute, {"score": "double"}, drop=(features,))

    return Detector("Isolation Forest", "isolation_forest", fit, score)


def path_tables(trees: pd.DataFrame) -> dict:
    """What attributions need of some trees, level by level over all of them, so that children stand behind parents.

    Per node: the split that leads to it (``feature``, ``cut``, ``low``: the side at or below the cut; -1 at roots), its
    ``parent``, the node on its path where the same feature decided last (``above``; the root where none did), the share of
    training cover that follows its path at that feature's splits, and at leaves the path length.
    """
    nodes: list[tuple] = []  # level, tree, own id in the tree, feature, cut, low, parent key, above key, share, value
    degree = 1
    for t, tree in enumerate(trees.to_dict("records")):
        feature, cut, cover = tree["feature"], tree["cut"], tree["cover"]
        todo = [(0, 0, -1, 0.0, False, None, 0, 1.0, {})]
        while todo:
            node, level, f, c, low, parent, above, share, last = todo.pop()
            own = feature[node]
            value = 0.0 if own >= 0 else tree["depth"][node] + float(expected_depth(cover[node]))
            nodes.append((level, t, node, f, c, low, node if parent is None else parent, above, share, value))
            degree = max(degree, len(last))
            if own < 0:
                continue
            before, passed = last.get(own, (0, 1.0))
            for child, side in ((tree["left"][node], True), (tree["right"][node], False)):
                z = passed * cover[child] / cover[node]
                todo.append((child, level + 1, own, cut[node], side, node, before, z, {**last, own: (child, z)}))
    nodes.sort()
    place = {(n[1], n[2]): i for i, n in enumerate(nodes)}
    levels = np.searchsorted([n[0] for n in nodes], range(nodes[-1][0] + 2)).tolist() if nodes else [0]
    _, tree_of, _, feature, cut, low, parent, above, share, value = (list(c) for c in zip(*nodes))
    at = lambda ids: [place[t, i] for t, i in zip(tree_of, ids)]
    return {"trees": len(trees), "degree": degree, "levels": levels, "feature": feature, "cut": cut, "low": low,
            "parent": at(parent), "above": at(above), "share": share, "value": value}


def path_contributions(x: np.ndarray, paths: dict, block: int = 64) -> tuple[np.ndarray, np.ndarray, float]:
    """(Path-dependent Shapley values of the path length, path length, its mean over the training cover), each summed over
    the trees of ``path_tables``.

    A leaf of value v whose path has features with pass flags o and cover shares z gives feature j
    v (o_j - z_j) times the integral over t in [0, 1] of prod_(i != j) (o_i t + z_i (1 - t)), exact at a few
    Gauss-Legendre nodes.  One sweep down carries the products to the nodes and one up adds v times the product over the
    leaves below each, so the work is linear in the nodes: what a split gives its feature, leaves below it included, is the
    sum at its child times (o - z) / (o t + z (1 - t)), less the same at the split of that feature before it.
    """
    feature, cut, low, parent, above, share, value = (
        np.asarray(paths[c]) for c in ("feature", "cut", "low", "parent", "above", "share", "value"))
    levels = [slice(a, b) for a, b in zip(paths["levels"][:-1], paths["levels"][1:])]
    t, weight = np.polynomial.legendre.leggauss(int(paths["degree"]) // 2 + 1)
    t, weight = 0.5 * (t + 1.0), 0.5 * weight
    inner = levels[0].stop
    order = inner + np.argsort(feature[inner:], kind="stable")
    named, starts = np.unique(feature[order], return_index=True)
    out, length = np.zeros(x.shape), np.zeros(len(x))
    for first in range(0, len(x), block):
        part = x[first:first + block].T
        passed = np.ones((len(feature), part.shape[1]), dtype=bool)
        passed[inner:] = (part[feature[inner:]] <= cut[inner:, None]) == low[inner:, None]
        reached = passed.copy()
        factor = np.ones((*passed.shape, len(t)))
        product = np.ones_like(factor)
        for level in levels[1:]:
            reached[level] &= reached[parent[level]]
            passed[level] &= passed[above[level]]
            factor[level] = passed[level, :, None] * t + share[level, None, None] * (1.0 - t)
            product[level] = product[parent[level]] * factor[level] / factor[above[level]]
        product *= value[:, None, None]
        for level in reversed(levels[1:]):
            for side in (True, False):  # a parent has one child on each side
                mine = level.start + np.flatnonzero(low[level] == side)
                product[parent[mine]] += product[mine]
        gain = (passed - share[:, None])[:, :, None] / factor
        effect = ((gain - gain[above]) * product) @ weight
        if len(order):
            out[first:first + block, named] = np.add.reduceat(effect[order], starts, axis=0).T
        length[first:first + block] = value @ reached
    cover = np.ones(len(feature))
    for level in levels[1:]:
        cover[level] = cover[parent[level]] * share[level] / share[above[level]]
    return out, length, float(cover @ value)


def tree_contributions(x: np.ndarray, tree: dict) -> np.ndarray:
    """Path-dependent Shapley values of one tree's path length for each row of ``x``."""
    return path_contributions(x, path_tables(pd.DataFrame([tree])))[0]


def forest_paths(forest: DataFrame, lay: Layout) -> DataFrame:
    """``path_tables`` of a forest, a few trees a row, made where the trees lie."""
    keys = [k for k in lay.keys if k in forest.columns]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in forest.schema.fields if f.name in keys)
    schema = (f"{head}, trees int, degree int, levels array<int>, feature array<int>, cut array<double>, low array<boolean>, "
              "parent array<int>, above array<int>, share array<double>, value array<double>")
    bundled = forest.withColumn("_bundle", F.floor(F.col("tree") / F.lit(_TREES_PER_GROUP)))
    return bundled.groupBy(*keys, "_bundle").applyInPandas(
        lambda pdf: pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **path_tables(pdf.sort_values("tree"))}]), schema)


def forest_attribution(rows: DataFrame, forest: DataFrame, lay: Layout, features: str = "features",
                       chunk_rows: int = 4096, spread_rows: int = 256) -> DataFrame:
    """Contribution of every feature to each row's mean path length (negative: pushes towards isolation), as an array
    beside ``base``, the mean path length over the training cover; contributions and base add up to ``path_length``.

    Path tables are made once per forest and written.  Below the shipping bound they travel to the tasks once and rows,
    dealt ``spread_rows`` at a time since little data is much work here, meet them in place; above it they meet chunks of
    ``chunk_rows`` rows, which outweigh them.
    """
    paths = cut_lineage(forest_paths(forest, lay), "forest-paths")

    def compute(chunk: pd.DataFrame, bundles: pd.DataFrame) -> dict:
        x = matrix_of(chunk[features])
        total, length, base, trees = np.zeros(x.shape), np.zeros(len(x)), 0.0, int(bundles["trees"].sum())
        for bundle in bundles.to_dict("records"):
            part, path, mean = path_contributions(x, bundle)
            total, length, base = total + part, length + path, base + mean
        return {"contributions": list(total / trees), "base": base / trees, "path_length": length / trees}

    dealt = spread(with_chunk(rows, spread_rows), *lay.keys, "_chunk").drop("_chunk")
    return per_chunk(dealt, paths, lay.keys, compute, {"contributions": "array<double>", "base": "double", "path_length": "double"},
                     drop=(features,), chunk_rows=chunk_rows)


def sample_rows(df: DataFrame, lay: Layout, size: int, seed: int = 42) -> DataFrame:
    """Seeded sample of at most ``size`` rows per series, for explanations (needs ``pos`` and ``n``).

    A hash filter first keeps a few times the wanted rows, so only those are ranked.
    """
    mixed = F.xxhash64(F.lit(seed), F.col("pos"), *lay.keys)
    unit = F.pmod(mixed, F.lit(1_000_003)) / F.lit(1_000_003.0)
    few = df.where(unit <= F.lit(4.0 * size + 100.0) / F.col("n")).withColumn("_rank", mixed)
    order = Window.partitionBy(*lay.keys).orderBy("_rank", "pos")
    return few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= size).drop("_rank", "_k")


def top_contributions(attributed: DataFrame, lay: Layout, names: list[str] | None = None, top: int = 15,
                      keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Largest contributions by size at each row, signed; a group is one row's features."""
    long = attributed.select(*lay.keys, *keep, F.posexplode("contributions").alias("_i", "contribution"))
    order = Window.partitionBy(*lay.keys, *keep).orderBy(F.abs("contribution").desc(), "_i")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1) if names else F.concat(F.lit("f"), F.col("_i"))
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
               .select(*lay.keys, *keep, "rank", name.alias("feature"), "contribution")


register_detector("isolation_forest", isolation_forest)
