"""Vectors packed into blocks, and query blocks met with them."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.session import cut_lineage

_BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary())])
_BLOCK_DDL = "dim int, block long, ids binary, values binary"


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, vector of doubles) of each partition in blocks of one dimension, in the order they come."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_block = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal next_block
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            if len(ids) > size:
                held[dim] = [(ids[size:], values[size:])]
            out = pa.RecordBatch.from_pydict({"dim": [dim], "block": [next_block], "ids": [ids[:size].tobytes()],
                                              "values": [values[:size].tobytes()]}, schema=_BLOCK)
            next_block += 1
            return out

        for batch in batches:
            lists = batch.column(1)
            lengths = np.asarray(pa.compute.list_value_length(lists))
            ids = batch.column(0).to_numpy()
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                values = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.setdefault(int(dim), []).append((ids[own], values))
                while sum(len(x) for x, _ in held.get(int(dim), [])) >= size:
                    yield block(int(dim))
        for dim in list(held):
            while dim in held:
                yield block(dim)
    return rows.mapInArrow(pack, _BLOCK_DDL)


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"], np.float64).reshape(-1, row["dim"])


def meet(queries: DataFrame, blocks: DataFrame, best_of: Callable, most: int, descending: bool, label: str, kind: str = "double") -> DataFrame:
    """query_id, rank, vec_id, score: ``best_of(queries, ids, values...)`` over every block, the ``most`` best of every query row
    kept, whether or not its id comes again; ``kind`` is the type of a score.

    Query blocks and vector blocks are laid on a grid: a cell holds one query block and a stripe of vector blocks (every
    S-th, so each stripe runs in the blocks' order), which bounds its memory; cells keep the best of their stripe, and a
    window per query joins them.  Block counts, two small numbers, are all that reaches the driver.
    """
    per_stripe = 16
    numbered = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1)
    # Only names of blocks are numbered in one place; their contents follow by a join on the block.
    q_names, x_names = (cut_lineage(numbered(df.select("dim", "block")), label) for df in (queries, blocks))
    sides = (q_names.groupBy("dim").agg(F.max("nth").alias("last_q"))
                    .join(x_names.groupBy("dim").agg(F.max("nth").alias("last_x")), "dim"))
    stripes = F.floor(F.col("last_x") / per_stripe).cast("int") + 1
    q = queries.join(q_names, ["dim", "block"]).join(sides, "dim").select(
        "dim", "ids", "values", "block", F.col("nth").alias("q"), F.explode(F.sequence(F.lit(0), stripes - 1)).alias("stripe"))
    x = blocks.join(x_names, ["dim", "block"]).join(sides, "dim").select(
        "dim", "ids", "values", "block", (F.col("nth") % stripes).alias("stripe"),
        F.explode(F.sequence(F.lit(0), F.col("last_q"))).alias("q"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            parts = [unpack(r) for _, r in right.sort_values("block").iterrows()]
            for _, r in left.iterrows():
                found.append(best_of(*unpack(r), parts).assign(block=r["block"]))
        columns = ["query_id", "place", "vec_id", "score", "block"]
        return pd.concat(found)[columns] if found else pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})

    keys = ["dim", "q", "stripe"]
    cells = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(cell, f"query_id long, place long, vec_id long, score {kind}, block long")
    order = F.col("score").desc() if descending else F.col("score").asc()
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The best rows seen for each query: smallest keys first, ties to the smaller id."""

    def __init__(self, n: int, most: int, kind: type = np.float64):
        self.most = most
        self.keys = [np.empty(0, kind)] * n
        self.ids = [np.empty(0, np.int64)] * n
        self.bound = np.full(n, np.inf)

    def add(self, query: int, keys: np.ndarray, ids: np.ndarray) -> None:
        keys, ids = np.concatenate([self.keys[query], keys]), np.concatenate([self.ids[query], ids])
        if len(keys) > 4 * self.most:
            near = keys <= np.partition(keys, self.most - 1)[self.most - 1]
            keys, ids = keys[near], ids[near]
        order = np.lexsort((ids, keys))[:self.most]
        self.keys[query], self.ids[query] = keys[order], ids[order]
        if len(order) == self.most:
            self.bound[query] = self.keys[query][-1]

    def frame(self, query_ids: np.ndarray, sign: int) -> pd.DataFrame:
        found = [len(x) for x in self.ids]
        return pd.DataFrame({"query_id": np.repeat(query_ids, found), "place": np.repeat(np.arange(len(found)), found),
                             "vec_id": np.concatenate(self.ids) if len(self.ids) else np.empty(0, np.int64),
                             "score": sign * np.concatenate(self.keys) if len(self.keys) else np.empty(0)})
