"""Documents cut into token pieces and packed into fixed windows by the sum-of-squares rule.

Each scan partition packs its own stream, so there is no shuffle and no task sees more than its split.  The open windows
of a partition are an array of counts per fill level; an incoming piece goes to the level (or a fresh window) that makes
the sum of squared counts smallest, which keeps levels evenly used and so keeps partners for every length around.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.tokens import encoder

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("sequence_tokens", pa.int64())])
# Room for 2^36 windows in a partition.
_PARTITION_BITS = 36


class LevelPacker:
    """Windows of ``capacity`` tokens, open ones kept by fill level.

    ``place`` takes a piece shorter than a window; ``close`` empties what is open at the end.  Both yield finished windows
    as lists of pieces (doc_id, start, ids, doc_tokens).
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """Fill level (0: a fresh window) whose use makes the sum of squared counts smallest; the fullest on a tie."""
        count, room = self.count, self.capacity - size
        # (n+1)^2 - n^2 for the level entered, (n-1)^2 - n^2 for the level left; a full window leaves the array.
        entered = np.append(2 * count[size:] + 1, 0)
        left = 1 - 2 * count[:room + 1]
        left[0] = 0
        change = entered + left
        change[1:][count[1:room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        size = len(piece[2])
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            yield window
        else:
            self.open[level + size].append(window)
            self.count[level + size] += 1

    def close(self) -> Iterator[list[tuple]]:
        """Fill the fullest open windows with pieces cut from the emptiest; the last is cut at powers of two, unpadded."""
        windows = deque((level, w) for level in range(self.capacity - 1, 0, -1) for w in self.open[level])
        self.__init__(self.capacity)
        while windows:
            level, window = windows.popleft()
            while level < self.capacity and windows:
                donor_level, donor = windows.pop()
                doc_id, start, ids, total = donor.pop()
                cut = max(0, len(ids) - (self.capacity - level))  # the tail of the piece moves, its head stays
                window.append((doc_id, start + cut, ids[cut:], total))
                level += len(ids) - cut
                if cut:
                    donor.append((doc_id, start, ids[:cut], total))
                if donor:
                    windows.append((donor_level - (len(ids) - cut), donor))
            if level == self.capacity:
                yield window
            else:
                yield from powers_of_two(window, level)


def powers_of_two(window: list[tuple], level: int) -> Iterator[list[tuple]]:
    pieces = deque(window)
    for bit in reversed(range(level.bit_length())):
        room, part = level & (1 << bit), []
        while room:
            doc_id, start, ids, total = pieces.popleft()
            part.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                pieces.appendleft((doc_id, start + room, ids[room:], total))
            room -= len(part[-1][2])
        if part:
            yield part


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    A document is its tokens (``tokenizer``: path of a tokenizers file) and ``end_id``.  Whole windows are cut from its
    start; the rest, shorter than a window, is placed by the sum-of-squares rule.  Sequences are full, or a power of two
    long (at most one of each power per partition), so nothing is padded.  ``ids`` holds little-endian unsigned 32-bit ids.

    Null and empty texts are one end id; null or repeated doc_ids are packed row by row; an empty table gives no rows.
    Other columns are ignored.  Sequence ids come from the scan partition and a counter, so a task that is run again
    gives the same ones.  Memory: the open windows (below one per level in practice) and one batch.
    """
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), LevelPacker(capacity)
        next_id = TaskContext.get().partitionId() << _PARTITION_BITS
        rows: list[tuple] = []
        held = 0

        def emit(window: list[tuple]) -> None:
            nonlocal next_id, held
            offset, total = 0, sum(len(p[2]) for p in window)
            for ident, start, ids, doc_tokens in window:
                rows.append((ident, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, next_id, offset, total))
                offset += len(ids)
            held += total
            next_id += 1

        def batch() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            held = 0
            return out

        for received in batches:
            for ident, body in zip(received.column(0).to_pylist(), received.column(1)):
                ids = np.append(encode(body.as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                whole = len(ids) - len(ids) % capacity
                for at in range(0, whole, capacity):
                    emit([(ident, at, ids[at:at + capacity], len(ids))])
                if whole < len(ids):
                    for window in packer.place((ident, whole, ids[whole:].copy(), len(ids))):
                        emit(window)
                if held >= 1 << 20:
                    yield batch()
        for window in packer.close():
            emit(window)
            if held >= 1 << 20:
                yield batch()
        if rows:
            yield batch()

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(pack, SCHEMA)
