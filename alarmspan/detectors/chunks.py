"""Row chunks of one series meet that series' model parameters: the shape of every model score in Python.

Written parameter tables below ``SHIP_BYTES`` (and four times that unpacked) travel to the tasks as one broadcast and rows are scored where they are,
without an exchange.  Beyond that, a chunk is a bounded run of rows, so a series of any length is many groups, and
parameters are copied to the chunks that need them through a join on the series.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmspan.layout import row_bytes
from alarmspan.session import cut_lineage

CHUNK_ROWS = 16_384
SHIP_BYTES = 16 * 1024 * 1024


def matrix_of(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Exchange for a Python stage: few bytes can mean much work there, so the adaptive planner, which merges partitions
    by bytes, must not merge these."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def with_chunk(df: DataFrame, rows: int = CHUNK_ROWS, pos: str = "pos") -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(rows)))


def fits(table: DataFrame, most: int) -> bool:
    """Whether a written table is at most ``most`` bytes, packed as it lies there and unpacked as tasks would hold it."""
    packed = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return packed <= most and (table.agg(F.sum(row_bytes(table))).first()[0] or 0) <= 4 * most


def per_chunk(rows: DataFrame, params: DataFrame, keys: Sequence[str], compute: Callable[[pd.DataFrame, pd.DataFrame], dict],
              outputs: dict[str, str], drop: Sequence[str] = ("features",), chunk_rows: int = CHUNK_ROWS,
              ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """Apply ``compute(rows, their series' parameter rows) -> {column: values}`` chunk by chunk.

    The result keeps the row columns except ``drop`` and adds ``outputs`` (name -> SQL type).  ``compute`` must not
    depend on how a series is cut into chunks.  Series without parameters give no rows.
    """
    shared = [k for k in keys if k in params.columns]
    kept = [f for f in rows.schema.fields if f.name not in drop]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()])
    names = [f.name for f in kept]

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[names].copy()
        if len(left) == 0 or len(right) == 0:
            return out.iloc[:0].assign(**{n: None for n in outputs})
        return out.assign(**compute(left, right))

    if fits(params, ship_bytes):
        by_series = {k: g for k, g in params.toPandas().groupby(shared)}
        shipped = rows.sparkSession.sparkContext.broadcast(by_series)

        def in_place(batches):
            for batch in batches:
                for key, part in batch.groupby(shared, sort=False):
                    if key in shipped.value:
                        for start in range(0, len(part), chunk_rows):
                            yield scored(part.iloc[start:start + chunk_rows], shipped.value[key])

        return rows.mapInPandas(in_place, schema)

    chunked = with_chunk(rows, chunk_rows)
    group = [*keys, "_chunk"]
    wanted = chunked.select(*group).distinct().join(params, shared)
    # Renamed keys: both sides descend from the same rows.
    right_group = [f"_key{i}" for i in range(len(group))]
    wanted = wanted.withColumnsRenamed(dict(zip(group, right_group)))
    return spread(chunked, *group).groupBy(*group).cogroup(spread(wanted, *right_group).groupBy(*right_group)).applyInPandas(scored, schema)


def with_halo_chunk(df: DataFrame, before: int, rows: int, pos: str = "pos") -> DataFrame:
    """Chunks of ``rows`` rows, each with the ``before`` rows ahead of it; only those are copied."""
    own, last = F.floor(F.col(pos) / F.lit(rows)), F.floor((F.col(pos) + F.lit(before)) / F.lit(rows))
    return df.withColumn("_chunk", F.explode(F.sequence(own, last)))


def per_halo_chunk(rows: DataFrame, params: DataFrame, keys: Sequence[str], compute: Callable[[pd.DataFrame, pd.DataFrame], dict],
                   outputs: dict[str, str], before: int, drop: Sequence[str] = ("features",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``per_chunk`` for a ``compute`` that looks ``before`` rows back: a chunk's own rows come out once each.

    ``compute`` gets the rows of a chunk and those ahead of it, in no order.
    """
    shared = [k for k in keys if k in params.columns]
    group = [*keys, "_chunk"]
    chunked = with_halo_chunk(rows, before, chunk_rows)
    kept = [f for f in rows.schema.fields if f.name not in drop]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()])

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})
        out = left[[f.name for f in kept]].assign(**compute(left, right))
        return out[left["pos"] // chunk_rows == left["_chunk"]]

    if fits(params, SHIP_BYTES):
        shipped = rows.sparkSession.sparkContext.broadcast({k: g for k, g in params.toPandas().groupby(shared)})

        def alone(left: pd.DataFrame) -> pd.DataFrame:
            key = tuple(left[k].iloc[0] for k in shared)
            return scored(left, shipped.value.get(key, ()))
        return spread(chunked, *group).groupBy(*group).applyInPandas(alone, schema)
    wanted = chunked.select(*group).distinct().join(params, shared)
    right = [f"_key{i}" for i in range(len(group))]
    wanted = wanted.withColumnsRenamed(dict(zip(group, right)))
    return spread(chunked, *group).groupBy(*group).cogroup(spread(wanted, *right).groupBy(*right)).applyInPandas(scored, schema)


def emitted_by_series(rows: DataFrame, keys: Sequence[str], emit: Callable[[pd.DataFrame, dict | None], pd.DataFrame], schema: str,
                      state: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """``emit(some rows of a series, its state row)`` for all rows: its columns behind the keys, in the order of ``schema``.

    Rows are taken where they are, in no order.  A state table below ``ship_bytes`` travels to the tasks; with a larger one,
    batches of a series' rows meet its row, dealt by a hash of the row so that no series is gathered.
    """
    stateful = state is not None
    ships = not stateful or fits(state, ship_bytes)
    shipped = rows.sparkSession.sparkContext.broadcast(
        {tuple(r[k] for k in keys): r.asDict() for r in state.collect()}) if stateful and ships else None
    names = [f.strip().split()[0].strip("`") for f in schema.split(", ")]

    def keyed(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return found.assign(**dict(zip(keys, key)))[names]

    if ships:
        def in_place(batches):
            for batch in batches:
                for key, some in batch.groupby(list(keys), sort=False):
                    own = shipped.value.get(key) if stateful else None
                    if own is not None or not stateful:
                        yield keyed(key, emit(some, own))
        return rows.mapInPandas(in_place, schema)

    def meet(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(own):
            return pd.DataFrame(columns=names)
        return keyed(tuple(some[k].iloc[0] for k in keys), emit(some, own.iloc[0].to_dict()))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_chunks"))
    dealt = rows.join(sizes, list(keys)).withColumn("_chunk", F.pmod(F.xxhash64(*rows.columns), F.col("_chunks"))).drop("_chunks")
    wanted = sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk")).join(state, list(keys))
    right = [f"_key{i}" for i in range(len(keys) + 1)]
    wanted = wanted.withColumnsRenamed(dict(zip([*keys, "_chunk"], right)))
    return spread(dealt, *keys, "_chunk").groupBy(*keys, "_chunk").cogroup(spread(wanted, *right).groupBy(*right)).applyInPandas(meet, schema)


def summed_by_series(rows: DataFrame, keys: Sequence[str], partial: Callable[[np.ndarray, dict | None], np.ndarray], feature: str,
                     state: DataFrame | None = None, before: int = 0, chunk_rows: int = CHUNK_ROWS,
                     ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """Sum over a series' rows of ``partial(matrix of some of them, the series' state row)``: (keys, total BINARY of doubles).

    Rows of no particular order are added up where they are, one vector per task and series, with no exchange of rows.
    With ``before`` each matrix is a chunk in order of ``pos`` behind that many earlier rows, and ``partial`` must count the
    chunk's own rows only.  A state table below ``ship_bytes`` travels to the tasks; a larger one meets its series' chunks.
    Vectors meet in ``tree_sums``.
    """
    shared = [k for k in keys if state is None or k in state.columns]
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([T.StructField(k, fields[k].dataType) for k in keys]
                          + [T.StructField("_part", T.LongType()), T.StructField("vector", T.BinaryType())])
    stateful = state is not None
    ships = not stateful or fits(state, ship_bytes)
    shipped = rows.sparkSession.sparkContext.broadcast(
        {tuple(r[k] for k in shared): r.asDict() for r in state.collect()}) if stateful and ships else None

    def state_of(key: tuple) -> dict | None:
        return shipped.value.get(tuple(k for k, name in zip(key, keys) if name in shared)) if shipped else None

    def frame(sums: dict[tuple, np.ndarray], part: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, part, v.tobytes()) for key, v in sums.items()], columns=schema.names)

    def in_place(batches):
        from pyspark import TaskContext
        sums, part = {}, TaskContext.get().partitionId() << 24
        for batch in batches:
            for key, some in batch.groupby(list(keys), sort=False):
                if stateful and state_of(key) is None:
                    continue
                v = partial(matrix_of(some[feature]), state_of(key))
                sums[key] = sums[key] + v if key in sums else v
            if sum(v.nbytes for v in sums.values()) > ship_bytes:
                yield frame(sums, part)
                sums, part = {}, part + 1
        yield frame(sums, part)

    def chunk(pdf: pd.DataFrame, params: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(pdf):
            return frame({}, 0)
        key = tuple(pdf[k].iloc[0] for k in keys)
        own = state_of(key) if params is None else params.iloc[0].to_dict() if len(params) else None
        if stateful and own is None:
            return frame({}, 0)
        x = matrix_of((pdf.sort_values("pos") if before else pdf)[feature])
        return frame({key: partial(x, own)}, int(pdf["_chunk"].iloc[0]))

    columns = list(dict.fromkeys([*keys, feature, *(["pos"] if before or not ships else [])]))
    if ships and not before:
        parts = rows.select(*columns).mapInPandas(in_place, schema)
    else:
        chunked = with_halo_chunk(rows.select(*columns), before, chunk_rows)
        group = [*keys, "_chunk"]
        if ships:
            parts = spread(chunked, *group).groupBy(*group).applyInPandas(lambda pdf: chunk(pdf), schema)
        else:
            wanted = chunked.select(*group).distinct().join(state, shared)
            right = [f"_key{i}" for i in range(len(group))]
            wanted = wanted.withColumnsRenamed(dict(zip(group, right)))
            parts = spread(chunked, *group).groupBy(*group).cogroup(spread(wanted, *right).groupBy(*right)).applyInPandas(chunk, schema)
    return tree_sums(parts, keys)


def tree_sums(parts: DataFrame, keys: Sequence[str], fan: int = 64) -> DataFrame:
    """Element-wise sums of (keys, _part, vector BINARY of doubles), ``fan`` vectors a task and round: (keys, total)."""
    parts = cut_lineage(parts, "partial-sums")
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["vector"].iloc[0]).copy()
        for body in pdf["vector"].iloc[1:]:
            total += np.frombuffer(body)
        return pdf.iloc[:1].assign(vector=[total.tobytes()])

    while True:
        groups = max(1, -(-most // fan))
        parts = parts.withColumn("_part", F.pmod(F.xxhash64("_part"), F.lit(groups)))
        parts = spread(parts, *keys, "_part").groupBy(*keys, "_part").applyInPandas(add, parts.schema)
        if groups == 1:
            return parts.select(*keys, F.col("vector").alias("total"))
        most = groups
