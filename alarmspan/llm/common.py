"""Small helpers the operators share."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def renamed(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one text column stays near ``most_bytes``; a longer single row comes alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of strings: multiplied bytes, mixed."""
    offsets, data = string_bytes(words)
    sums = byte_sums(offsets, data)
    mixed = (sums[offsets[1:]] - sums[offsets[:-1]] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


def string_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of strings without nulls."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def byte_sums(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Running sums over all strings of each byte times a power of its place: differences of them name prefixes."""
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    powers = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, int(size.max(initial=0)) + 2, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])


def in_fold(doc_id) -> Column:
    """True for the held-out fifth: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
