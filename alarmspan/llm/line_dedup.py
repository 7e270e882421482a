"""Repeated passages of lines, found by winnowed line hashes, removed wherever they come again."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.common import renamed
from alarmspan.session import cut_lineage

# A line with words: its number and its 128-bit digest.  A window: its first and last line, counted from a stretch's start.
_LINE = np.dtype([("line", "<i4"), ("digest", "V16")])
_SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])
_PRINTS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("line_hash", pa.int64()),
                     ("before", pa.int32()), ("lines", pa.binary()), ("spans", pa.binary())])


def worded_lines(text: str | None) -> tuple[list[int], list[bytes], list[int]]:
    """Numbers, digests and word counts of the lines that have words."""
    import xxhash
    lines = [(i, line, len(line.split())) for i, line in enumerate((text or "").encode().split(b"\n"))]
    lines = [x for x in lines if x[2]]
    return [x[0] for x in lines], [xxhash.xxh3_128_digest(x[1], 7) for x in lines], [x[2] for x in lines]


def smallest_lines(hashes: list[int], words: list[int], least_words: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, place of the smallest hash, the first on a tie) of every window, as indices of lines with words."""
    smallest: deque[int] = deque()  # rising hashes of the current window
    end = held = 0
    for start in range(len(hashes)):
        while end < len(hashes) and held < least_words:
            while smallest and hashes[smallest[-1]] > hashes[end]:
                smallest.pop()
            smallest.append(end)
            held += words[end]
            end += 1
        if held < least_words:
            return
        yield start, end - 1, smallest[0]
        held -= words[start]
        if smallest[0] == start:
            smallest.popleft()


def line_hashes(digests: list[bytes]) -> list[int]:
    return [int.from_bytes(d[:8], "little") >> 1 for d in digests]


def windows(text: str | None, least_words: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first line, last line, line of the smallest hash, that hash, the window's digest) per line that opens a window.

    A window is the shortest run of lines from there with ``least_words`` words.  Lines without words take no part, but
    lie inside a window that spans them.  The window's smallest line hash (the first, on a tie) is its fingerprint: it
    depends on the window alone, so two places that share a window share its fingerprint, wherever they stand.
    """
    numbers, digests, words = worded_lines(text)
    hashes = line_hashes(digests)
    for start, end, at in smallest_lines(hashes, words, least_words):
        yield numbers[start], numbers[end], numbers[at], hashes[at], window_digest(b"".join(digests[start:end + 1]))


def window_digest(digests: bytes) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(digests, 8)


def selected(text: str | None, least_words: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """The text's fingerprints, each place once: (line, its hash, lines before it in its stretch, stretch, windows).

    The stretch is what the windows that select the line span together, fewer than twice ``least_words`` lines.
    """
    numbers, digests, words = worded_lines(text)
    hashes = line_hashes(digests)
    held: list[tuple[int, int]] = []

    def place(at: int) -> tuple[int, int, int, bytes, bytes]:
        a, b = held[0][0], held[-1][1] + 1
        lines = np.array(list(zip(numbers[a:b], digests[a:b])), _LINE)
        return numbers[at], hashes[at], at - a, lines.tobytes(), (np.array(held, np.int32) - a).astype("<i4").tobytes()

    last = -1
    for start, end, at in smallest_lines(hashes, words, least_words):
        if held and at != last:
            yield place(last)
            held = []
        held.append((start, end))
        last = at
    if held:
        yield place(last)


def fingerprints(docs: DataFrame, least_words: int) -> DataFrame:
    """Fingerprints of ``docs`` (doc, row, text): one row per place that some window selects."""
    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PRINTS)], schema=_PRINTS)
            rows.clear()
            return out

        for received in batches:
            for doc, row, text in zip(received.column(0).to_pylist(), received.column(1).to_pylist(), received.column(2)):
                for found in selected(text.as_py(), least_words):
                    rows.append((doc, row, *found))
                    if len(rows) >= 20_000:
                        yield batch()
        if rows:
            yield batch()
    return docs.mapInArrow(select, "doc long, row long, at int, line_hash long, before int, lines binary, spans binary")


def extended(before: int, lines: bytes, spans: bytes, other_before: int, others: bytes) -> tuple[tuple[int, int] | None, list]:
    """A match grown line by line, both ways, as far as the two stretches agree: its (first, last) line in whole windows, and
    (first, last, digest) of the windows that it does not hold.

    A stretch holds every window that selects its fingerprint.  Where a match goes on beyond it, the next fingerprint does,
    since the windows overlap.
    """
    mine, theirs = np.frombuffer(lines, _LINE), np.frombuffer(others, _LINE)
    digests, held = mine["digest"].tolist(), theirs["digest"].tolist()
    low = high = 0
    while low < min(before, other_before) and digests[before - low - 1] == held[other_before - low - 1]:
        low += 1
    while high < min(len(mine) - before, len(theirs) - other_before) and digests[before + high] == held[other_before + high]:
        high += 1
    low, high = before - low, before + high - 1
    inside, rest = [], []
    for start, end in np.frombuffer(spans, _SPAN).tolist():
        first, last = int(mine["line"][start]), int(mine["line"][end])
        if low <= start and end <= high:
            inside.append((first, last))
        else:
            rest.append((first, last, window_digest(b"".join(digests[start:end + 1]))))
    return (inside[0][0], inside[-1][1]) if inside else None, rest


def repeated_runs(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc, row, runs): runs of lines (first, last) of ``docs`` (doc, row, text) that stood earlier in the same words.

    Places of a fingerprint are joined to its earliest place, and each match is extended both ways with the lines compared.
    Joining each place to the earliest only keeps the join linear however often a line comes; a hot line is one row on one
    side, and the other side can be split.  A line that is common in other surroundings may have repeats which do not
    agree with its earliest place: windows that no match holds are compared among themselves, so none is lost.  That is
    whole: of equal windows, either all agree with the fingerprint's earliest place, or none does.
    """
    prints = cut_lineage(fingerprints(docs, least_words), "line-prints")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row", "at")
    earliest = (prints.groupBy("line_hash").agg(F.min(F.struct(place.alias("place"), "before", "lines")).alias("origin"),
                                                F.max(place).alias("latest"))
                      .where("origin.place != latest").drop("latest"))
    pairs = prints.join(earliest, "line_hash").where(place > F.col("origin.place"))

    @F.pandas_udf("first int, last int, rest array<struct<first int, last int, window binary>>")
    def extend(before: pd.Series, lines: pd.Series, spans: pd.Series, other: pd.Series, others: pd.Series) -> pd.DataFrame:
        made = [extended(*x) for x in zip(before, lines, spans, other, others)]
        return pd.DataFrame({
            "first": pd.Series([m and m[0] for m, _ in made], dtype="Int32"), "last": pd.Series([m and m[1] for m, _ in made], dtype="Int32"),
            "rest": [[{"first": a, "last": b, "window": w} for a, b, w in rest] for _, rest in made]})

    grown = pairs.select("doc", "row", "at", "line_hash", extend("before", "lines", "spans", "origin.before", "origin.lines").alias("m"))
    grown = cut_lineage(grown.select("doc", "row", "at", "line_hash", "m.*"), "line-matches")
    rest = grown.select("doc", "row", "at", "line_hash", F.explode("rest").alias("w")).select("doc", "row", "at", "line_hash", "w.*")
    first_of = (rest.groupBy("line_hash", "window").agg(F.min(place).alias("origin"), F.max(place).alias("latest"))
                    .where("origin != latest").drop("latest"))
    others = rest.join(first_of, ["line_hash", "window"]).where(place > F.col("origin")).select("doc", "row", "first", "last")
    found = grown.where("first IS NOT NULL").select("doc", "row", "first", "last").unionByName(others)
    return found.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def drop_repeated_lines(docs: DataFrame, least_words: int = 50, doc_id: str = "doc_id", text: str = "text",
                        length: str | None = "n_chars") -> DataFrame:
    """``docs`` without passages of ``least_words`` words or more, in whole lines, that stand earlier in the table.

    Earlier means a smaller doc_id (null last; rows of one doc_id in the order of a hash of their text), or further up in
    the same text.  Every line of a later place goes, with lines without words inside it; of equal lines the earliest
    always stays.  Lines are equal in all bytes (told by 128-bit digests).  Identical rows (same doc_id and text) are one place and keep the same
    lines.  Null texts stay null; empty texts, and texts all of whose lines go, are empty; an empty table gives no rows.
    Columns are those of ``docs`` with the new text and, if there is such a column, its length in characters; after them
    n_lines (before) and n_removed under free names (see ``added_columns``).
    """
    row, runs, cut, its_doc, its_row = renamed(docs, "_row", "_runs", "_cut", "_f_doc", "_f_row")
    keyed = docs.withColumn(row, F.xxhash64(doc_id, text))
    found = repeated_runs(keyed.select(F.col(doc_id).cast("long").alias("doc"), F.col(row).alias("row"),
                                       F.col(text).alias("text")), least_words)
    found = found.select(F.col("doc").alias(its_doc), F.col("row").alias(its_row), F.col("runs").alias(runs))
    joined = keyed.join(found, (keyed[row] == F.col(its_row)) & keyed[doc_id].cast("long").eqNullSafe(F.col(its_doc)), "left")
    # Only texts that lose lines go through Python.
    cutter = F.pandas_udf(without_runs, "text string, removed int")
    touched = joined.withColumn(cut, cutter(F.when(F.col(runs).isNotNull(), F.col(text)), F.col(runs)))
    shorter = F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.col(f"{cut}.text"))
    columns = [F.char_length(shorter).cast(docs.schema[c].dataType).alias(c) if c == length
               else shorter.alias(c) if c == text else F.col(c) for c in docs.columns]
    n_lines, n_removed = added_columns(docs)
    newlines = F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    return touched.select(*columns, (F.coalesce(newlines, F.lit(-1)) + 1).cast("long").alias(n_lines),
                          F.coalesce(F.col(f"{cut}.removed"), F.lit(0)).cast("long").alias(n_removed))


def without_runs(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """The text without the lines of the runs, and how many those are."""
    out = []
    for text, spans in zip(texts, runs):
        if text is None or spans is None:
            out.append((None, 0))
            continue
        lines = text.split("\n")
        gone = bytearray(len(lines))
        for span in spans:
            gone[span["first"]:span["last"] + 1] = b"\1" * (span["last"] + 1 - span["first"])
        out.append(("\n".join([line for line, g in zip(lines, gone) if not g]), sum(gone)))
    return pd.DataFrame(out, columns=["text", "removed"])


def added_columns(docs: DataFrame) -> list[str]:
    return renamed(docs, "n_lines", "n_removed")
