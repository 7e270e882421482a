"""Runs of words that repeat with a period, exactly: candidates on a harmonic grid, extents from a grammar."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.common import renamed
from alarmspan.llm.grammar import Grammar

# Words taken through one grammar together, and grid places looked at in one go: work space, not results.
BATCH_WORDS, GRID_PLACES = 300_000, 2_000_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_FOUND_DDL = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def grid(starts: np.ndarray, sizes: np.ndarray, least: int, powers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) pairs such that every run of a text holds one of its period, a period before its end or earlier.

    ``starts`` and ``sizes`` of the texts in one sequence.  A run with period q has a length of max(least, powers * q) at
    least; all of it but the last q words are places whose word comes again q later.  Places that far apart, less one q,
    cannot all miss it, so a text of n words needs about n/q of them per q and n log n in all.
    """
    longest = np.where(sizes >= least, sizes // powers, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(longest) - longest, longest)
    apart = np.maximum(least, powers * period) - period
    places = (sizes[text] - period + apart - 1) // apart
    upto = np.concatenate([[0], np.cumsum(places)])
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + GRID_PLACES, "right")) - 1)
        n = places[first:last]
        row = np.repeat(np.arange(first, last), n)
        nth = np.arange(len(row)) - np.repeat(upto[first:last] - upto[first], n)
        yield starts[text[row]] + nth * apart[row], period[row]
        first = last


def find_runs(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, powers: int) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs of the texts in ``symbols``, by start, then period.

    Before, between and after the texts stands a symbol that occurs once.  A place of the grid whose word comes again a
    period later is extended both ways by the grammar; what is long enough is a run.  A multiple of a run's period gives
    the same stretch again, and as a stretch is three periods long or more, the smallest found is its smallest period.
    """
    grammar, found = None, []
    for place, period in grid(starts, sizes, least, powers):
        hit = symbols[place] == symbols[place + period]
        place, period = place[hit], period[hit]
        # least - period is over two, so a neighbour agrees as well.
        hit = (symbols[place + 1] == symbols[place + 1 + period]) | (symbols[place - 1] == symbols[place - 1 + period])
        place, period = place[hit], period[hit]
        if not len(place):
            continue
        grammar = grammar or Grammar(symbols)
        start = place + 1 - grammar.extend(place, place + period, back=True)
        end = place + period + grammar.extend(place, place + period)
        long = end - start >= np.maximum(least, powers * period)
        found.append(np.stack([start[long], end[long], period[long]]))
    if not found:
        return tuple(np.zeros((3, 0), np.int64))
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _batch(texts: list[list[bytes]], least: int, powers: int) -> pa.Array:
    names = defaultdict(count().__next__)
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int32)
    for words, start in zip(texts, starts.tolist()):
        symbols[start:start + len(words)] = np.fromiter(map(names.__getitem__, words), np.int32, len(words))
    marks = np.append(starts - 1, len(symbols) - 1)
    symbols[marks] = len(names) + np.arange(len(marks))
    start, end, period = find_runs(symbols, starts, sizes, least, powers)
    text = np.searchsorted(starts, start, "right") - 1
    again = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(again, start + period, 1)
    np.add.at(again, end, -1)
    gone = np.cumsum(again) > 0
    collapsed = []
    for words, at in zip(texts, starts.tolist()):
        lost = gone[at:at + len(words)]
        if lost.any():
            words = [words[i] for i in np.flatnonzero(~lost).tolist()]
        collapsed.append(b" ".join(words))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(start - starts[text]), pa.array(end - start), pa.array(period)], fields=list(_RUN)))
    return pa.StructArray.from_arrays([runs, pa.array(collapsed, pa.binary()).cast(pa.string())], fields=list(_FOUND))


def periodic_runs(docs: DataFrame, text: str = "text", least_words: int = 24, least_powers: int = 3) -> DataFrame:
    """``docs`` with all maximal runs of its texts, and the texts without what the runs repeat.

    Words are what stands between ASCII white space, compared byte by byte.  A run is a stretch of words with smallest
    period q, as long as ``least_words`` and ``least_powers`` periods, that keeps its period over no neighbouring word.
    Added, under free names (see ``added_columns``): runs (start, length, period by word number, in order of start, then
    period) and collapsed (words that no run holds after its first q words, joined by one space).  Null and empty texts and
    texts of white space have no runs and collapse to the empty text; repeated rows are rows; an empty table gives none.
    A text is held whole by its task, with its grammar (about 50 bytes a word); no row crosses a shuffle.
    """
    if least_powers < 3 or least_words < 2 * least_powers:
        raise ValueError("a run is three periods long at least: shorter ones can have several smallest stretches")

    @F.arrow_udf(_FOUND_DDL)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for received in batches:
            parts, texts, held = [], [], 0
            for value in received:
                words = (value.as_py() or "").encode().split()
                if texts and held + len(words) > BATCH_WORDS:
                    parts.append(_batch(texts, least_words, least_powers))
                    texts, held = [], 0
                texts.append(words)
                held += len(words)
            if texts:
                parts.append(_batch(texts, least_words, least_powers))
            yield pa.concat_arrays(parts) if parts else pa.array([], _FOUND)
    (both,), (runs, collapsed) = renamed(docs, "_found"), added_columns(docs)
    out = docs.withColumn(both, found(F.col(text)))
    return out.select(*docs.columns, F.col(f"{both}.runs").alias(runs), F.col(f"{both}.collapsed").alias(collapsed))


def added_columns(docs: DataFrame) -> list[str]:
    return renamed(docs, "runs", "collapsed")


def with_planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every tenth text made periodic from some word on; a query's own trial of the operator.

    With h the crc32 of the id's digits and g = h // 10, a text of n > 0 words with h % 10 = 0 keeps its words before a =
    g % n and repeats those from a on with period 1 + (n - a) // (3 + g % 8).  Others, and rows without an id, stay.
    """
    words_, = renamed(docs, "_words")
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.when(chosen, F.col(text)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size(words_).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                                       lambda i: F.get(F.col(words_), place(i).cast("int"))), " ")
    changed = F.when(chosen & (F.coalesce(n, F.lit(0)) > 0), planted).otherwise(F.col(text))
    return docs.withColumn(words_, words).select(*[changed.alias(c) if c == text else F.col(c) for c in docs.columns])
