"""Exact largest inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds on the rest."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.vectors import Best, meet, packed, unpack, usable
from alarmspan.session import cut_lineage

BLOCK, QUERY_BLOCK = 4096, 256
_SUMS = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, the right singular vectors of all vectors, strongest first, from the sum of block products.

    Products are added per position on the cluster; dimension squared numbers reach the driver, however many rows there are.
    """
    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                _, x = unpack(row)
                sums[row["dim"]] = sums.get(row["dim"], 0) + x.T @ x
        for dim, s in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * dim, "i": list(range(dim)), "row": s.tolist()}, schema=_SUMS)

    rows = (blocks.mapInArrow(products, "dim int, i int, row array<double>")
                  .select("dim", "i", F.posexplode("row").alias("j", "v")).groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect())
    sums = {dim: np.zeros((dim, dim)) for dim in {r["dim"] for r in rows}}
    for r in rows:
        sums[r["dim"]][r["i"], r["j"]] = r["v"]
    return {dim: np.linalg.eigh(s)[1][:, ::-1] for dim, s in sums.items()}


def largest_products(vectors: DataFrame, queries: DataFrame, most: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
                     vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``most`` largest inner products of each query with all vectors but those of
    its own id, ties to the smaller vec_id, over components floor(scale * x).

    Blocks hold vectors by descending length.  In a cell, once a query's length times the longest vector left cannot reach
    its ``most``-th score, it is done; else a partial sum over the strongest rotated quarter plus the product of the lengths
    of the rest bounds every score from above, and only what may still reach it is multiplied out, in 64-bit whole numbers.
    A query meets vectors of its own dimension.  Null ids, and vectors null, empty, with null or non-finite components, or so
    long that their products need not fit 64 bits (a length of 2^31 and more after scaling), take no part; zero vectors do;
    repeated rows count each, as vectors and as queries; fewer vectors give fewer rows; empty tables none.
    """
    # Floats near the limits of a long are capped there, far beyond what takes part.
    scaled = lambda x: F.greatest(F.least(x.cast("double") * F.lit(scale), F.lit(4e18)), F.lit(-4e18))
    whole = F.transform(F.col(vector), lambda x: F.floor(scaled(x)).cast("double"))

    def ready(df: DataFrame) -> DataFrame:
        kept = df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        return kept.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")).withColumn("length", length).where(
            F.col("length") < 2.0 ** 62)

    def blocked(df: DataFrame, size: int, label: str) -> DataFrame:
        by_length = ready(df).repartitionByRange(F.desc("length"), F.asc("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")
        return cut_lineage(packed(by_length.select("vec_id", "v"), size), label)

    blocks = blocked(vectors, BLOCK, "topk-blocks")
    asked = blocked(queries, QUERY_BLOCK, "topk-queries")
    turned = rotations(blocks)

    def best_of(query_ids: np.ndarray, q: np.ndarray, parts: list) -> object:
        rotation = turned[q.shape[1]]
        head = max(1, q.shape[1] // 4)
        q_turned = q @ rotation
        q_rest, q_length = np.linalg.norm(q_turned[:, head:], axis=1), np.linalg.norm(q, axis=1)
        exact = q.astype(np.int64)
        best = Best(len(q), most, np.int64)
        for ids, x in parts:
            lengths = np.linalg.norm(x, axis=1)
            slack = 1e-9 * (1 + q_length * lengths.max())
            live = np.flatnonzero(-best.bound <= q_length * lengths.max() + slack)
            if not len(live):
                continue
            x_turned = x @ rotation
            upper = q_turned[live, :head] @ x_turned[:, :head].T
            upper += q_rest[live, None] * np.linalg.norm(x_turned[:, head:], axis=1) + slack[live, None]
            for row, i in zip(upper, live):
                near = np.flatnonzero((row >= -best.bound[i]) & (ids != query_ids[i]))
                if len(near):
                    best.add(i, -(x[near].astype(np.int64) @ exact[i]), ids[near])
        return best.frame(query_ids, -1)

    return meet(asked, blocks, best_of, most, True, "topk-names", "long")
