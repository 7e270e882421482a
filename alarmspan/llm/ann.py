"""Near neighbours by counting collisions on single projections: query-centred windows that widen together."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.vectors import Best, meet, packed, usable
from alarmspan.session import cut_lineage

BLOCK, QUERY_BLOCK = 8192, 256
# Projections; share of them whose windows must hold a vector before it is verified; growth of the radius per round; how
# close, in radii, the last wanted neighbour must be before a query stops.  A vector one radius away lies in a window with
# probability 0.68 and passes with 0.93, one at 0.9 radii with 0.98.
PROJECTIONS, SHARE, GROWTH, CERTAIN = 48, 0.58, 1.25, 0.9
SEED = 11


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, PROJECTIONS))


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``most`` nearest vectors found for each query, by Euclidean distance in double
    precision, ties to the smaller vec_id; never a vector of the query's own id.

    Every vector is in the index: per block, one sorted array per projection.  A query opens a window of plus and minus
    one radius around its own value in each array, and widens all of them together by enlarging the radius (no new hash
    tables); a vector that lies in enough windows is verified.  The query leaves a block when its ``most``-th distance is
    below 0.9 radii, or every vector has been verified, so small blocks are searched in full.  Nothing is capped.

    A query meets vectors of its own dimension.  Null ids, and vectors null, empty, zero or with null or non-finite
    components, take no part; repeated rows count each, as vectors and as queries; fewer vectors give fewer rows; empty tables none.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))

    def blocked(df: DataFrame, size: int, label: str) -> DataFrame:
        some = usable(F.col(vector)) & F.exists(F.col(vector), lambda x: x != 0) & F.col(vec_id).isNotNull()
        return cut_lineage(packed(df.where(some).select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("v")), size), label)

    blocks, asked = blocked(vectors, BLOCK, "ann-blocks"), blocked(queries, QUERY_BLOCK, "ann-queries")
    needed = int(np.ceil(SHARE * PROJECTIONS))

    def best_of(query_ids: np.ndarray, q: np.ndarray, parts: list) -> object:
        lines = directions(q.shape[1])
        q_at = q @ lines
        best = Best(len(q), most)
        for ids, x in parts:
            at = x @ lines
            order = np.argsort(at, axis=0, kind="stable").T.copy()
            arrays = np.take_along_axis(at.T, order, axis=1)
            n = len(ids)
            # The first windows hold a few wanted neighbours' worth of vectors.
            start = np.median(np.abs(arrays[:, -1] - arrays[:, 0])) * min(1.0, 8 * most / n) / 2 or 1.0
            for i in range(len(q)):
                counts, done = np.zeros(n, np.int32), ids == query_ids[i]
                low = high = np.array([np.searchsorted(a, v) for a, v in zip(arrays, q_at[i])])
                radius = start
                while True:
                    left = np.array([np.searchsorted(a, v - radius, "left") for a, v in zip(arrays, q_at[i])])
                    right = np.array([np.searchsorted(a, v + radius, "right") for a, v in zip(arrays, q_at[i])])
                    left, right = np.minimum(left, low), np.maximum(right, high)
                    fresh = [o[a:b] for o, a, b in zip(order, left, low)] + [o[a:b] for o, a, b in zip(order, high, right)]
                    counts += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
                    low, high = left, right
                    near = np.flatnonzero((counts >= needed) & ~done)
                    if len(near):
                        gap = x[near] - q[i]
                        best.add(i, np.sqrt((gap * gap).sum(axis=1)), ids[near])
                        done[near] = True
                    if best.bound[i] <= CERTAIN * radius or done.all():
                        break
                    radius *= GROWTH
        return best.frame(query_ids, 1)

    return meet(asked, blocks, best_of, most, False, "ann-names")
