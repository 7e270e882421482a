"""SimHash fingerprints, links between close ones by one-wildcard segment variants, and the groups they form."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.llm.common import renamed
from alarmspan.llm.links import components
from alarmspan.session import cut_lineage

BITS = 64
SEED = 42
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash over word shingles: a bit is set if it is set in over half of the shingles' XXH64; 0 without words."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(joined, SEED)
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        starts, ends = [-1, *spaces], [*spaces[width - 1:], len(joined)]
        hashes = b"".join([digest(joined[a + 1:b], SEED) for a, b in zip(starts, ends)])
    values = np.frombuffer(hashes, ">u8").astype(np.uint64)
    counts = np.empty((8, 8), dtype=np.int64)  # [byte, bit in byte]
    edges = np.arange(0, len(values), 255)     # a byte lane holds 255 ones
    for bit in range(8):
        lanes = np.add.reduceat(values >> np.uint64(bit) & _ONES, edges)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(counts.ravel() * 2 > len(values), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, out: str, text: str = "text", width: int = 4) -> DataFrame:
    """Add the fingerprint as a long (the same 64 bits, signed).  Only the text goes through Python."""
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))
    return docs.withColumn(out, hashed(F.col(text)))


def variant_masks(segments: int, most: int) -> list[tuple[int, int | None]]:
    """(mask of compared bits, wildcard bit or None) of every signature.

    With ``most`` differing bits over ``segments`` segments, some ``chosen`` segments together differ by at most one bit,
    so two close fingerprints agree on one combination exactly, or on one variant of it that leaves the differing bit out.
    """
    chosen = 1 if segments <= most else segments - most + 1
    if most // segments > 1:
        raise ValueError("too few segments: one of them may differ by two bits")
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    masks = []
    for combination in combinations(range(segments), chosen):
        bits = [b for s in combination for b in range(edges[s], edges[s + 1])]
        mask = sum(1 << b for b in bits)
        masks += [(mask, None), *((mask & ~(1 << b), b) for b in bits)]
    return masks


def segments_for(fingerprints: int, most: int) -> int:
    """Fewest segments whose signatures leave a fingerprint about as many chance neighbours as signatures, at most."""
    least = next(m for m in range(2, BITS) if most // m <= 1)
    for segments in [least, *range(max(least, most) + 1, most + 5)]:
        chosen = 1 if segments <= most else segments - most + 1
        if fingerprints <= 2 ** (BITS * chosen // segments):
            break
    return segments


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fingerprints: DataFrame, most: int = 4, segments: int = 3, column: str = "fingerprint") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints with 1 to ``most`` differing bits; a pair may come more than once.

    ``fingerprints``: one row for each.  A variant with wildcard bit i meets only those that differ at i (zeros join
    ones), so that no pair is built that the exact signature already has.  The join is told to be sorted: the planner
    sizes exploded rows by those before, so it would ship all variants of a table that is small enough itself.
    """
    masks = variant_masks(segments, most)
    array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    f = F.col(column).cast("long")
    signed = fingerprints.select(f.alias("f"), F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("v"))
    mask = F.element_at(array([_signed(m) for m, _ in masks], "long"), F.col("v") + 1)
    wild = F.element_at(array([-1 if b is None else b for _, b in masks], "int"), F.col("v") + 1)
    signed = signed.select("f", "v", F.col("f").bitwiseAND(mask).alias("rest"),
                           F.when(wild >= 0, F.expr("1L").bitwiseAND(F.call_function("shiftright", F.col("f"), wild))).alias("bit"))
    zeros = signed.where("bit IS NULL OR bit = 0").select(F.col("f").alias("a"), "v", "rest", F.col("bit").alias("bit_a"))
    ones = signed.where("bit IS NULL OR bit = 1").select(F.col("f").alias("b"), "v", "rest")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most) & (F.col("bit_a").isNotNull() | (F.col("a") < F.col("b")))
    return zeros.hint("merge").join(ones, ["v", "rest"]).where(near).select("a", "b")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, most: int = 4,
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id reachable over links of at most ``most`` bits.

    Equal fingerprints are one node, so copies make no pairs; nodes are linked by ``close_pairs`` and joined by
    ``components``.  The number of segments follows from the number of distinct fingerprints: more of them make longer
    signatures, and every choice finds every link.  Null and empty texts have fingerprint 0 and are linked like any other.
    Null doc_ids keep their rows and give a group no name unless it has none but them (then component_id is null); repeated
    rows keep theirs; an empty table gives no rows.  ``keep``: other columns to carry along.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"),
                        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    printed = cut_lineage(with_fingerprint(named, "fingerprint", "_text", width).drop("_text"), "fingerprints")
    nodes = cut_lineage(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    pairs = close_pairs(nodes, most, segments_for(nodes.count(), most)).distinct()
    joined = components(pairs)
    rooted = nodes.join(joined, nodes.fingerprint == joined.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(names, "root").select("fingerprint", "component_id")
    return printed.join(labels, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id (of rows with one doc_id, one).

    Rows without a doc_id have no place in that order and stay.  Columns are those of ``docs``.
    """
    key, first, nth, its_id, its_key = renamed(docs, "_text_key", "_first", "_nth", "_w_id", "_w_key")
    keyed = docs.withColumn(key, F.xxhash64(text))
    groups = near_duplicate_groups(keyed, doc_id, text, keep=(key,), **how)
    winners = (groups.where("doc_id IS NOT NULL").groupBy("component_id")
                     .agg(F.min(F.struct("doc_id", key)).alias("w"))
                     .select(F.col("w.doc_id").alias(its_id), F.col(f"w.{key}").alias(its_key), F.lit(True).alias(first)))
    joined = keyed.join(winners, (keyed[doc_id].cast("long") == F.col(its_id)) & (keyed[key] == F.col(its_key)), "left")
    same = Window.partitionBy(doc_id, key).orderBy(key)
    numbered = joined.where(F.col(first) | F.col(doc_id).isNull()).withColumn(nth, F.row_number().over(same))
    return numbered.where((F.col(nth) == 1) | F.col(doc_id).isNull()).select(*[keyed[c] for c in docs.columns])
