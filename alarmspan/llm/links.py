"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.session import cut_lineage


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node reachable; nodes are longs.

    Alternates two steps that keep components and shorten paths: each node hands its larger neighbours its smallest one
    (large star), then its smaller neighbours theirs (small star).  Links stay about as many as at the start, a hub is one
    row per neighbour, and rounds grow with the logarithm of a path's length.  Every round is written to the shared folder;
    only its count and a checksum reach the driver.
    """
    edges = pairs.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = _written(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(small_least, F.col("u") == F.col("w"))
        star = small.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges, now = _written(star.where("u != v").distinct())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    written = cut_lineage(edges, "links")
    return written, tuple(written.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
