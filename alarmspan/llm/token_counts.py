"""Token counts from one count per distinct pre-token.

Words between ASCII white space never share a token in a tokenizer that drops white space, so a text's count is the sum
over its distinct words of occurrences times pieces.  A block of documents sends each distinct word once, with the
documents it stands in, to the task its hash names; there the tokenizer counts its pieces once for all blocks; what comes
back is one array of sums per block and task.  Ids are never kept.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.common import slices, string_hashes
from alarmspan.llm.tokens import one_thread_tokenizer

# A place is a row in its block and a count, 16 bits each.
BLOCK_BYTES, BLOCK_ROWS = 6 << 20, (1 << 16) - 1
# Words a counting task remembers; a task that meets more forgets them and counts those that come again anew.
KNOWN_WORDS = 1_000_000
DOCS, WORDS, SUMS = 0, 1, 2
_PARTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_PARTS_DDL = "bucket int, block long, kind int, body binary"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _bytes(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _batch(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), _PARTS)], schema=_PARTS)


def word_places(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block; then, ordered by word: word code, row and occurrences."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    pairs = coded.indices.to_numpy().astype(np.int64)
    pairs *= len(texts)
    pairs += np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    times = np.diff(np.append(first, len(pairs)))
    code, row = np.divmod(pairs[first], max(1, len(texts)))
    return coded.dictionary, code, row, times


def _spread(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: one row with its documents' ids and sizes, and one per bucket with that bucket's distinct words: the
        words, the places of each, and the places' rows and occurrences (a count beyond 16 bits takes several places)."""
        block = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
            texts = pc.fill_null(part.column("text"), "")
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            yield _rows([(block % buckets, block, DOCS, _bytes(doc_id=part.column("doc_id"), n_bytes=sizes))])
            # The tokenizer lower-cases, so letters may be joined here too, unless a special string could come about.
            words, code, row, times = word_places(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
            while (times >> 16).any():
                over = times >> 16 > 0
                code, row = np.append(code, code[over]), np.append(row, row[over])
                times = np.append(np.where(over, times - 65_535, times), np.full(over.sum(), 65_535))
            bucket = (string_hashes(words) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket[code] * np.int64(len(words) or 1) + code, kind="stable")
            code, row, times = code[order], row[order].astype(np.uint16), times[order].astype(np.uint16)
            by_bucket = np.argsort(bucket, kind="stable")
            places = np.bincount(code, minlength=len(words))[by_bucket].astype(np.uint32)
            word_edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1)).tolist()
            place_edges = np.concatenate([[0], np.cumsum(places, dtype=np.int64)])[word_edges].tolist()
            words = words.take(pa.array(by_bucket))
            rows = []
            for k in range(buckets):
                a, b, c, d = word_edges[k], word_edges[k + 1], place_edges[k], place_edges[k + 1]
                if a < b:
                    rows.append((k, block, WORDS, _packed(words.slice(a, b - a), places[a:b], row[c:d], times[c:d])))
                if len(rows) == 512:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)
            block += 1
            del texts, words, code, row, times, bucket, order, by_bucket, places, rows
            pa.default_memory_pool().release_unused()  # a worker lives on through many tasks
    return run


def _packed(words: pa.Array, places: np.ndarray, row: np.ndarray, times: np.ndarray) -> bytes:
    joined = "\n".join(words.to_pylist()).encode()
    head = np.array([len(joined), len(places), len(row)], dtype="<u4").tobytes()
    plain = head + joined + places.astype("<u4").tobytes() + row.astype("<u2").tobytes() + times.astype("<u2").tobytes()
    return len(plain).to_bytes(4, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked(body: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    plain = pa.decompress(body[4:], int.from_bytes(body[:4], "little"), codec="zstd", asbytes=True)
    size, n, m = np.frombuffer(plain, "<u4", 3).tolist()
    at = 12 + size
    return (plain[12:at].decode().split("\n"), np.frombuffer(plain, "<u4", n, at), np.frombuffer(plain, "<u2", m, at + 4 * n),
            np.frombuffer(plain, "<u2", m, at + 4 * n + 2 * m))


def _sums(tokenizer: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by block.  A word is tokenized where it first comes up, once for all blocks of the task, which is the
        only one to see it; a block's sums leave when the next block begins."""
        counter = one_thread_tokenizer(tokenizer)
        known: dict[str, int] = {}
        now, sums = None, np.zeros(0, np.int64)

        for batch in batches:
            out = []
            for block, kind, body in zip(*(batch.column(k).to_pylist() for k in ("block", "kind", "body"))):
                if kind == DOCS:
                    out.append((0, block, DOCS, body))
                    continue
                if block != now:
                    if now is not None:
                        out.append((0, now, SUMS, _bytes(n=pa.array(sums))))
                    now, sums = block, np.zeros(BLOCK_ROWS, np.int64)
                words, places, row, times = _unpacked(body)
                fresh = [w for w in words if w not in known]
                if fresh:
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                        fresh = words
                    for at in range(0, len(fresh), 2000):
                        some = fresh[at:at + 2000]
                        known.update(zip(some, [len(e) for e in counter.encode_batch_fast(some, add_special_tokens=False)]))
                pieces = np.repeat(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), places)
                np.add.at(sums, row, pieces * times)
            if out:
                yield _rows(out)
        if now is not None:
            yield _rows([(0, now, SUMS, _bytes(n=pa.array(sums)))])
    return run


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by block: its documents, then its sums from every counting task."""
    now, docs, sums = None, None, np.zeros(0, np.int64)

    def counts() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("n_bytes"), pa.array(sums[:len(docs)])], schema=_COUNTS)

    for batch in batches:
        for block, kind, body in zip(*(batch.column(k).to_pylist() for k in ("block", "kind", "body"))):
            if block != now:
                if now is not None:
                    yield counts()
                now, sums = block, np.zeros(BLOCK_ROWS, np.int64)
            if kind == DOCS:
                docs = _batch(body)
            else:
                sums = sums + _batch(body).column("n").to_numpy()
    if now is not None:
        yield counts()


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, as tokenizers counts the whole text without added special tokens.

    ``tokenizer``: path of a tokenizers file whose pre-tokenizer drops white space and whose normaliser lower-cases.
    ``buckets``: into how many parts words are dealt by hash (four per shuffle partition, 1 024 at least, by default).
    Special strings in a text count as the file's default has them.  Null and empty texts have 0 bytes and 0 tokens; rows
    are counted one by one, so null or repeated doc_ids keep their rows; an empty table gives no rows; other columns are
    ignored.  A word in all documents is one entry per 6 MB block, so it weighs no more on its task than any other word
    of as many blocks.  Memory: a block, or a task's distinct words.
    """
    buckets = buckets or max(1024, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_spread(buckets), _PARTS_DDL)
    sums = parts.repartition("bucket").sortWithinPartitions("block").mapInArrow(_sums(tokenizer), _PARTS_DDL)
    return (sums.repartition("block").sortWithinPartitions("block", "kind")
                .mapInArrow(_joined, "doc_id long, n_bytes long, n_tokens long"))
