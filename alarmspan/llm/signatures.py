"""Ranked lexical search over bit-sliced Bloom signatures: upper bounds from bitmaps, exact scores where they do not exclude."""
from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmspan.llm.common import slices, string_hashes
from alarmspan.session import cut_lineage

# A signature key says "this term occurs so often or oftener"; the last step is open above.
STEPS = (1, 2, 3, 5, 9, 17, 33)
BITS_A_KEY, HASHES = 12, 4
# Work space: the texts indexed in one go; a block's documents and the bits of its signatures; the narrowest signature.
SLICE_BYTES, BLOCK_DOCS, BLOCK_BITS, LEAST_WIDTH = 8 << 20, 1024, 1 << 24, 64
# Queries sent to the tasks together, whatever the size of the query table, and those whose bounds are held at one time.
QUERY_ROWS, QUERY_BYTES, HELD_BYTES = 5_000, 4 << 20, 128 << 10

# Term bytes as they are, A-Z lowered, everything else that is ASCII turned into a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = pa.schema([("width", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                    ("texts", pa.list_(pa.string())), ("slices", pa.binary()), ("terms", pa.list_(pa.string())),
                    ("df", pa.list_(pa.int64()))])
_INDEX_DDL = "width long, doc_ids array<long>, sizes array<long>, texts array<string>, slices binary, terms array<string>, df array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order: maximal stretches of ASCII letters and digits and of everything beyond ASCII, A-Z lowered."""
    return (text or "").encode().translate(_TERMS).split()


def key_bits(hashes: np.ndarray, step: np.ndarray | int, width: int) -> np.ndarray:
    """Slices of (term hash, step) keys in a signature of ``width`` bits, a power of two: one row per key."""
    mixed = (hashes + np.asarray(step, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    stride = mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20) | np.uint64(1)
    return ((mixed[:, None] + np.arange(HASHES, dtype=np.uint64) * stride[:, None]) & np.uint64(width - 1)).astype(np.int64)


def counted_terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts; then, by text and term: number of the text, number of the term, occurrences."""
    spaced = pa.array([(t or "").encode().translate(_TERMS) for t in texts], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(spaced)
    coded = lists.values.dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    there = np.append(pc.binary_length(terms).to_numpy() > 0, False)[code]  # a text's outer spaces leave empty terms
    pairs = np.sort(row[there] * (len(terms) + 1) + code[there])
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return terms, *np.divmod(pairs[first], len(terms) + 1), np.diff(first, append=len(pairs))


def _blocks(ids: list, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    terms, row, code, times = counted_terms(texts)
    hashes = string_hashes(terms).astype(np.uint64)
    steps = np.searchsorted(np.array(STEPS), times, "right")
    size = np.bincount(row, times, minlength=len(texts)).astype(np.int64)
    bits = np.bincount(row, steps, minlength=len(texts)) * BITS_A_KEY
    widths = LEAST_WIDTH * 4 ** np.ceil(np.log2(np.maximum(bits / LEAST_WIDTH, 1)) / 2).astype(np.int64)
    for width in np.unique(widths[size > 0]).tolist():
        members = np.flatnonzero((widths == width) & (size > 0))
        most = min(BLOCK_DOCS, max(8, BLOCK_BITS // width))
        for docs in np.split(members, range(most, len(members), most)):
            place = np.full(len(texts), -1)
            place[docs] = np.arange(len(docs))
            mine = np.flatnonzero(place[row] >= 0)
            across = 8 * -(-len(docs) // 8)
            grid = np.zeros(width * across, bool)
            for step in range(int(steps[mine].max())):
                over = mine[steps[mine] > step]
                grid[key_bits(hashes[code[over]], step, width) * across + place[row[over]][:, None]] = True
            present, df = np.unique(code[mine], return_counts=True)
            values = [width, [ids[d] for d in docs], size[docs], [texts[d] for d in docs], np.packbits(grid.reshape(-1, across), axis=1).tobytes(),
                      None, df]
            columns = [pa.array([v], f.type) for v, f in zip(values, _INDEX)]
            columns[5] = pa.ListArray.from_arrays(pa.array([0, len(present)], pa.int32()), terms.take(pa.array(present)))
            yield pa.RecordBatch.from_arrays(columns, schema=_INDEX)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of the index of ``docs``; no shuffle, usable for any queries.

    A block holds documents of about one size: their ids, sizes in terms and texts, one bitmap over them per signature bit
    (slices), and each term's number of documents.  Signatures are as wide as their keys need, so that long texts do not
    fill theirs.  Documents without a term have no place in it.
    """
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for received in slices(batches, "text", SLICE_BYTES):
            yield from _blocks(received.column(0).to_pylist(), received.column(1).to_pylist())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(blocks, _INDEX_DDL)


@dataclass
class Queries:
    """Query rows on their way to the tasks: distinct terms with hash and weight, and each row's terms by number."""
    terms: list[bytes]
    weights: np.ndarray
    rows: list[np.ndarray]
    docs: int        # documents with a term
    places: int      # terms of all documents, repeats included
    k: int

    @classmethod
    def of(cls, rows: list[list[bytes]], weight: dict[bytes, int], *rest: int) -> "Queries":
        terms = sorted({t for row in rows for t in row})
        number = {t: i for i, t in enumerate(terms)}
        return cls(terms, np.array([weight[t] for t in terms], np.int64),
                   [np.array([number[t] for t in r], np.int64) for r in rows], *rest)


def saturated(times: np.ndarray, size: np.ndarray, docs: int, places: int) -> np.ndarray:
    """Millionths of a term's weight that ``times`` occurrences earn in a document of ``size`` terms; rises with times."""
    return 1_000_000_000 * times // (1000 * times + 8 * (10 + 90 * size * docs // places))


def upper_bounds(slices_: np.ndarray, width: int, sizes: np.ndarray, queries: Queries, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the terms that some document may hold: their numbers, and the most each document may earn with them.

    The slices of a key, intersected, are the documents that may hold the term so often: all that do, and some that do not.
    A document earns at most what the upper end of its highest step earns, and never more than its size allows.
    """
    may = np.bitwise_and.reduce(slices_[key_bits(hashes, 0, width)], axis=1)
    some = np.flatnonzero(may.any(axis=1))
    may, hashes = may[some], hashes[some]
    step = np.unpackbits(may, axis=1)[:, :len(sizes)]
    left = np.arange(len(some))
    for s in range(1, len(STEPS)):
        may = may & np.bitwise_and.reduce(slices_[key_bits(hashes, s, width)], axis=1)
        go = may.any(axis=1)
        if not go.any():
            break
        may, hashes, left = may[go], hashes[go], left[go]
        step[left] += np.unpackbits(may, axis=1)[:, :len(sizes)]
    most = [0, *(edge - 1 for edge in STEPS[1:]), np.iinfo(np.int32).max]
    earned = np.stack([saturated(np.minimum(t, sizes), sizes, queries.docs, queries.places) for t in most])
    return some, np.take_along_axis(earned, step.astype(np.int64), axis=0) * queries.weights[some][:, None]


class _Best:
    """The best of a task's documents for each query of a group."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.number = {t: i for i, t in enumerate(queries.terms, 1)}
        self.hashes = string_hashes(pa.array(queries.terms, pa.binary()).cast(pa.string())).astype(np.uint64)
        self.rows = [[(i + 1, int(queries.weights[i])) for i in row.tolist()] for row in queries.rows]
        # Worst first: (score, has an id, doc_id negated).
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in self.rows]

    def take(self, width: int, ids: list, sizes: np.ndarray, texts: pa.ListScalar, bits: np.ndarray) -> None:
        """Documents of a block in order of their bounds, until a bound no longer reaches a query's list."""
        queries, k = self.queries, self.queries.k
        some, most = upper_bounds(bits, width, sizes, queries, self.hashes)
        place = np.full(len(self.hashes), -1)
        place[some] = np.arange(len(some))
        read: dict[int, dict[int, int]] = {}
        for terms, row, heap in zip(queries.rows, self.rows, self.heaps):
            mine = place[terms]
            mine = mine[mine >= 0]
            if not len(mine):
                continue
            bound = most[mine].sum(axis=0)
            docs = np.flatnonzero(bound >= (heap[0][0] if len(heap) == k else 1))
            for d in docs[np.argsort(-bound[docs], kind="stable")].tolist():
                order = (ids[d] is not None, -(ids[d] or 0))
                if len(heap) == k and (int(bound[d]), *order) <= heap[0]:
                    if bound[d] < heap[0][0]:
                        break
                    continue
                if d not in read:
                    read[d] = self.earned(texts[d].as_py(), sizes[d])
                score = sum(w * read[d].get(i, 0) for i, w in row)
                if score > 0:
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, *order))

    def earned(self, text: str, size: np.int64) -> dict[int, int]:
        times = Counter(filter(None, map(self.number.get, terms_of(text))))
        each = saturated(np.fromiter(times.values(), np.int64, len(times)), size, self.queries.docs, self.queries.places)
        return dict(zip(times, each.tolist()))


def _search(batches: Iterable[pa.RecordBatch], groups: list[Queries]) -> Iterator[pa.RecordBatch]:
    best = [_Best(queries) for queries in groups]
    for received in batches:
        for width, ids, sizes, texts, body in zip(*(received.column(i) for i in range(5))):
            bits = np.frombuffer(body.as_py(), np.uint8).reshape(width.as_py(), -1)
            for group in best:
                group.take(width.as_py(), ids.as_py(), np.array(sizes.as_py(), np.int64), texts, bits)
    heaps = [heap for group in best for heap in group.heaps]
    found = [(q, -i if named else None, score) for q, heap in enumerate(heaps) for score, named, i in heap]
    columns = list(zip(*found)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                     names=["query", "doc_id", "score"])


def query_blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Rows of ``queries`` (item_id, text) streamed to the driver a block at a time; a longer single row comes alone."""
    block, held = [], 0
    for row in queries.select(F.col(item_id), F.col(text)).toLocalIterator():
        size = len(row[1] or "")
        if block and (len(block) >= QUERY_ROWS or held + size > QUERY_BYTES):
            yield block
            block, held = [], 0
        block.append(tuple(row))
        held += size
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every row of ``queries``.

    A query's terms count once each.  With N documents that hold a term, L terms in all, n of a document, df documents that
    hold a term and tf occurrences: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + 90nN div L, and a document scores
    the sum of w * (10^9 tf div (1000tf + 8m)).  Equal scores go by doc_id, null ids last.

    ``index`` (from ``build_index``, written) is read once for a block of queries: each task keeps the best k of every
    query, reads the texts that the bounds do not exclude, and hands on k rows a query at most.  Query rows that repeat get
    their list each; null and empty queries, and those no document shares a term with, get none.
    """
    spark = index.sparkSession
    counts = index.select(F.size("doc_ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    docs, places = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    kind = dict(queries.dtypes)[item_id]
    out = []
    for block in query_blocks(queries, item_id, text):
        asked = [sorted(set(terms_of(body))) for _, body in block]
        terms = sorted({t for row in asked for t in row})
        named = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(terms)], "number int, term string")
        held = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
                     .join(named, "term").groupBy("number").agg(F.sum("df").alias("df")))
        # One row a term of the block: bounded by QUERY_BYTES.
        df = np.zeros(len(terms), np.int64)
        for number, n in held.collect():
            df[number] = n
        weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
        weight, groups, held_bytes = dict(zip(terms, weights.tolist())), [[]], 0
        present = {t for t, n in zip(terms, df) if n}
        for row in asked:
            size = sum(map(len, row))
            if groups[-1] and held_bytes + size > HELD_BYTES:
                groups.append([])
                held_bytes = 0
            groups[-1].append([t for t in row if t in present])
            held_bytes += size
        sent = [Queries.of(rows, weight, docs, places, k) for rows in groups]
        found = index.select("width", "doc_ids", "sizes", "texts", "slices").mapInArrow(
            lambda batches, sent=sent: _search(batches, sent), "query int, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        items = spark.createDataFrame([(i, row[0]) for i, row in enumerate(block)], f"query int, item_id {kind}")
        out.append(ranked.join(items, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if len(out) > 1:  # a written table for each block of queries, not one plan that holds them all
        out = [cut_lineage(found, "search-block") for found in out]
    none = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else none


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``search`` over ``docs``, whose index is written to the shared folder first."""
    return search(cut_lineage(build_index(docs, doc_id, text), "signature-index"), queries, k, item_id, query_text)
