"""HyperMinHash near-duplicates: compressed minimum registers, banded, estimated, and confirmed on the full sets."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.common import slices
from alarmspan.llm.links import components
from alarmspan.session import cut_lineage

# A sketch has BANDS * ROWS registers of a byte each: up to 14 leading zeros, then 4 bits of the minimum's mantissa.
BANDS, ROWS, EMPTY, CAP = 64, 7, 255, 14
REGISTERS = BANDS * ROWS
# A register of sketch class c is a minimum over 1 / (ROWS << c) of the set; small sets are hashed BANDS >> c times over.
CLASSES = 7
# A block of a group: its rows and the members of their sets, about; and the columns multiplied at one time.
BLOCK_ROWS, BLOCK_MEMBERS, PRODUCT_COLUMNS = 256, 131_072, 8_192
# Texts looked up by a shipped list of places up to this many, by a join of both tables beyond.
SHIPPED_PLACES = 500_000
_SKETCHES = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("class", pa.int32()),
                       ("registers", pa.binary()), ("upper", pa.binary())])
_SKETCHES_DDL = "doc_id long, place long, n long, node long, class int, registers binary, upper binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


_SEEDS = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch_class(n: int) -> int:
    """Two to four members of a set of ``n`` to a bucket, where there are enough."""
    return min(CLASSES - 1, max(0, (n // (2 * ROWS)).bit_length() - 1))


def upper_class(n: int, least: float) -> int | None:
    """The next class, if a set of ``n`` can be similar to one that belongs there."""
    c = sketch_class(n)
    return c + 1 if c + 1 < CLASSES and n >= least * (2 * ROWS << c + 1) else None


def minima(hashes: np.ndarray, c: int) -> np.ndarray:
    """Least lower half of the hashes in each bucket (the upper half picks it); 2^32 in empty ones."""
    buckets, passes = ROWS << c, BANDS >> c
    h = _mixed(hashes[None, :] ^ _SEEDS[:passes, None])
    at = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) + np.arange(passes)[:, None] * buckets
    out = np.full(REGISTERS, 1 << 32, np.int64)
    np.minimum.at(out, at.ravel(), (h & np.uint64(0xFFFFFFFF)).astype(np.int64).ravel())
    return out


def compressed(least: np.ndarray) -> np.ndarray:
    zeros = np.minimum(32 - np.frexp(np.maximum(least, 1).astype(np.float64))[1], CAP)
    mantissa = np.where(zeros < CAP, least << zeros + 1, least << CAP) >> 28 & 15
    return np.where(least >> 32, EMPTY, zeros * 16 + mantissa).astype(np.uint8)


def _cells() -> tuple[np.ndarray, np.ndarray]:
    zeros, mantissa = np.divmod(np.arange((CAP + 1) * 16), 16)
    size = np.where(zeros < CAP, 2.0 ** -(zeros + 5), 2.0 ** -(CAP + 4))
    low = np.where(zeros < CAP, 2.0 ** -(zeros + 1.0), 0) + mantissa * size
    return low, low + size


_LOW, _HIGH = _cells()


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of every sketch of ``a`` with every sketch of ``b`` (rows of registers), and the registers behind each.

    The share of equal registers is too high by those that are equal by chance.  The chance is the sum over registers'
    values of the probabilities that the minimum of either set, at so many members a bucket, falls there.
    """
    def falls(n: np.ndarray) -> np.ndarray:
        load = (n / (ROWS << c))[:, None]
        return np.exp(-load * _LOW) - np.exp(-load * _HIGH)
    chance = falls(n_a) @ falls(n_b).T
    equal = np.stack([((row == b) & (row != EMPTY)).sum(1) for row in a])
    empty_a, empty_b = (a == EMPTY).astype(np.float32), (b == EMPTY).astype(np.float32)
    used = np.maximum(REGISTERS - empty_a @ empty_b.T, 1)
    return (equal / used - chance) / (1 - chance), used


def shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: ``width`` words between ASCII white space, A-Z lowered.

    Fewer words make one shingle; no words, none.
    """
    import xxhash
    lists = pc.ascii_split_whitespace(pa.array([(t or "").encode().lower() for t in texts], pa.binary()).cast(pa.string()))
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    code = coded.indices.to_numpy()
    there = np.append(pc.binary_length(coded.dictionary).to_numpy() > 0, False)[code]
    row, h = row[there], hashes[code[there]]
    ends = np.searchsorted(row, np.arange(len(texts)), "right")
    start = 0
    for end in ends.tolist():
        one = h[start:end]
        start = end
        if not len(one):
            yield one
            continue
        reach = min(width, len(one))
        mixed = _mixed(one[:len(one) - reach + 1] + np.uint64(reach))
        for i in range(1, reach):
            mixed = _mixed(mixed + one[i:len(one) - reach + 1 + i])
        yield np.unique(mixed)


def sketches(docs: DataFrame, width: int, least: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, place (hash of the text), n, node (hash of the set; null if empty), class, its registers, those of the next."""
    import xxhash

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for received in slices(batches, "text", 8 << 20, 4096):
            kept = list(shingles(received.column(2).to_pylist(), width))
            own = [minima(h, sketch_class(len(h))) if len(h) else None for h in kept]
            up = [None if not len(h) or upper_class(len(h), least) is None else minima(h, upper_class(len(h), least)) for h in kept]
            both = compressed(np.stack([m for m in own + up if m is not None] or [np.zeros(REGISTERS, np.int64)])).tobytes()
            cut = iter(range(0, len(both), REGISTERS))
            rows = [[None if m is None else both[(i := next(cut)):i + REGISTERS] for m in ms] for ms in (own, up)]
            columns = [received.column(0), received.column(1), [len(h) for h in kept],
                       [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None for h in kept],
                       [sketch_class(len(h)) for h in kept], *rows]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SKETCHES)],
                                             schema=_SKETCHES)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    return named.mapInArrow(sketch, _SKETCHES_DDL)


def led_groups(nodes: DataFrame) -> DataFrame:
    """leader, class, node: groups in which every two nodes (node, class, registers) that share a band meet.

    Of a band's nodes the one whose bands hold most nodes in all leads it, and bands with one leader are one group: copies
    with small changes share many bands with what they were made from, so their bands make about one group, not one each.
    """
    part = F.substring("registers", F.col("band") * ROWS + 1, F.lit(ROWS))
    bands = nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).where(part != F.lit(bytes([EMPTY]) * ROWS))
    bands = bands.select(F.xxhash64("class", "band", part).alias("key"), "class", "node")
    several = bands.groupBy("key", "class").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut_lineage(bands.join(several, ["key", "class"]), "shared-bands")
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    ranked = shared.select("key", "class", "node").join(reach, "node")
    leaders = ranked.groupBy("key", "class").agg(F.max_by("node", F.struct("reach", "node")).alias("leader"))
    return shared.join(leaders, ["key", "class"]).select("leader", "class", "node").distinct()


def full_sets(members: DataFrame, places: DataFrame, docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """node, shingles (sorted 64-bit hashes) of the nodes in ``members``, from their texts.

    ``places``: one (node, doc_id, place) for each node.  A list of places of a checked size is shipped to the table, so
    that only texts asked for are read by Python.
    """
    asked = places.join(members.select("node").distinct(), "node").select("node", F.col("doc_id").alias("_id"), "place")
    asked = cut_lineage(asked, "places")
    ask = F.broadcast(asked) if asked.count() <= SHIPPED_PLACES else asked
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    texts = named.join(ask, (named.place == ask.place) & named.doc_id.eqNullSafe(ask["_id"])).select("node", "text")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for received in slices(batches, "text", 8 << 20, 4096):
            sets = [h.tobytes() for h in shingles(received.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([received.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
    # A row that repeats gives its set again.
    return texts.mapInArrow(hashed, "node long, shingles binary").dropDuplicates(["node"])


def pieces(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of several sets by number, the set each belongs to, and the sets' sizes; members of one set only are left out."""
    sizes = np.array([len(s) // 8 for s in sets])
    _, number, times = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)
    several = times > 1
    name = np.cumsum(several) - 1
    keep = several[number]
    return name[number[keep]], np.repeat(np.arange(len(sets)), sizes)[keep], sizes


def links_of_cell(nodes: np.ndarray, registers: np.ndarray, sets: list[bytes], c: int, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Links (node, node) that connect whatever pairs of ``left`` and ``right`` rows connect, one a node at most.

    Sketches first: rows whose estimates put them far below ``least`` (six deviations) of all others are left out.  Then all
    intersections of the others at once, as a product of their membership matrices, and the exact comparison.
    """
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    sizes = np.array([len(s) // 8 for s in sets])
    j, used = estimates(registers[left], registers[right], sizes[left], sizes[right], c)
    likely = (j >= least - 6 * np.sqrt(least * (1 - least) / used)) & (left[:, None] != right[None, :])
    left, right, likely = left[likely.any(1)], right[likely.any(0)], likely[np.ix_(likely.any(1), likely.any(0))]
    if not len(left):
        return np.zeros((0, 2), np.int64)
    rows = np.union1d(left, right)
    member, of, size = pieces([sets[i] for i in rows])
    a, b = np.searchsorted(rows, left), np.searchsorted(rows, right)
    shared = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(member.max(initial=-1)) + 1, PRODUCT_COLUMNS):
        some = (member >= start) & (member < start + PRODUCT_COLUMNS)
        matrix = np.zeros((len(rows), PRODUCT_COLUMNS), np.float32)
        matrix[of[some], member[some] - start] = 1
        shared += matrix[a] @ matrix[b].T
    shared = shared.astype(np.int64)
    union = size[a][:, None] + size[b][None, :] - shared
    linked = likely & (1000 * shared >= round(1000 * least) * union)
    # Smallest name reachable inside the cell.
    name = np.arange(len(rows))
    while True:
        before = name.copy()
        np.minimum.at(name, a, np.where(linked, name[b][None, :], len(rows)).min(axis=1, initial=len(rows)))
        np.minimum.at(name, b, np.where(linked, name[a][:, None], len(rows)).min(axis=0, initial=len(rows)))
        if (name == before).all():
            break
    moved = np.flatnonzero(name != np.arange(len(rows)))
    return np.stack([nodes[rows[moved]], nodes[rows[name[moved]]]], axis=1)


def group_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect what the groups of ``members`` (leader, class, node) hold of similar sets.

    A group is dealt into blocks of bounded rows and set members by a hash, and every two of its blocks meet in a cell of
    their own, so no group is gathered in one task whatever its size; a cell hands on a link a node at most, not its pairs.
    """
    group = ["leader", "class"]
    full = members.join(nodes, ["node", "class"]).join(sets, "node")
    size = members.join(nodes.select("node", "class", "n"), ["node", "class"]).groupBy(*group).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = full.join(size, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks", "n")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        registers = np.frombuffer(b"".join(pdf["registers"]), np.uint8).reshape(len(pdf), REGISTERS)
        i, j, block = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), pdf["block"].to_numpy()
        found = links_of_cell(pdf["node"].to_numpy(), registers, list(pdf["shingles"]), int(pdf["class"].iloc[0]),
                              np.flatnonzero(block == i), np.flatnonzero(block == j), least)
        return pd.DataFrame(found, columns=["a", "b"])
    return cells.groupBy(*group, "i", "j").applyInPandas(meet, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: groups of documents whose shingle sets are similar.

    Links are pairs with Jaccard similarity of ``least`` (in thousandths) or more, checked on the sets themselves; a pair at
    0.8 shares no band, and is lost, with a probability of 3 in 10^7, a closer one much less.  Shingles are compared by
    64-bit hashes, and documents with one set (by a hash of all its members) are one node, so copies make no pairs.  Nodes
    that share a band meet in their leader's group, block by block, and every such pair is compared.

    Null and empty texts, and texts of white space, have no set: n_shingles 0, linked with nothing, component_id their
    doc_id, kept.  A row without doc_id belongs to its group; a group of such rows alone has no component_id and keeps them.
    Repeated rows are rows, and all of a first document's rows are kept.  A text is held whole by its task.  An empty table
    gives no rows.
    """
    printed = cut_lineage(sketches(docs, width, least, doc_id, text), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).alias("at")
    places = cut_lineage(printed.where("node IS NOT NULL").groupBy("node").agg(first).select("node", "at.doc_id", "at.place"), "node-places")
    one = printed.where("node IS NOT NULL").select("node", "n", "class", "registers", "upper").dropDuplicates(["node"])
    both = F.explode(F.array(F.struct("class", "registers"), F.struct((F.col("class") + 1).alias("class"), F.col("upper").alias("registers"))))
    nodes = cut_lineage(one.select("node", "n", both.alias("s")).where("s.registers IS NOT NULL").select("node", "n", "s.*"), "nodes")
    members = cut_lineage(led_groups(nodes), "led-groups")
    sets = cut_lineage(full_sets(members, places, docs, width, doc_id, text), "full-sets")
    labels = components(cut_lineage(group_links(members, nodes, sets, least), "links"))
    named = places.join(labels, "node", "left").select("node", F.col("doc_id").alias("least_id"), F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "component_id")
    out = printed.where("node IS NOT NULL").join(named, "node").select("doc_id", "n", "component_id")
    out = out.unionByName(printed.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
