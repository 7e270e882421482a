"""Recompression: a run-length grammar of a sequence, and longest common extensions read off it."""
from __future__ import annotations

import numpy as np
import pandas as pd


class Grammar:
    """Levels of a sequence under alternating block and pair compression.

    A block step replaces every maximal repetition of one symbol by a symbol of its own (symbol, times).  A pair step calls
    each symbol left or right by a hash of its name and replaces every left symbol followed by a right one by a symbol of
    the pair.  Both look at nothing but the symbols replaced, so equal stretches get equal symbols but for their edges,
    which is what lets two places be compared by climbing.  Names are given per distinct block or pair, not by hash, so
    equal symbols are equal stretches.  About a quarter of the places goes with each pair step; the levels together hold a
    few times the sequence.

    The first and the last symbol of the sequence must occur nowhere else.
    """

    def __init__(self, symbols: np.ndarray):
        now = np.ascontiguousarray(symbols, dtype=np.int32)
        fresh = int(now.max(initial=0)) + 1
        # Per level: whether it is a block step, its symbols, where each parent's children start (and the end), each one's parent.
        self.levels: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(now) > 1:
            starts = np.concatenate([[0], np.flatnonzero(now[1:] != now[:-1]) + 1])
            if len(starts) < len(now):
                times = np.diff(starts, append=len(now))
                above, many = now[starts], np.flatnonzero(times > 1)
                named, names = pd.factorize(above[many].astype(np.int64) << 32 | times[many])
                above[many] = named + fresh
                fresh += len(names)
                self._push(True, now, starts)
                now = above
            left = self._coin(now, step)
            step += 1
            at = np.flatnonzero(left[:-1] & ~left[1:])
            if len(at):
                stays = np.ones(len(now), bool)
                stays[at + 1] = False
                starts = np.flatnonzero(stays)
                above = now[starts]
                named, names = pd.factorize(now[at].astype(np.int64) << 32 | now[at + 1])
                above[at - np.arange(len(at))] = named + fresh
                fresh += len(names)
                self._push(False, now, starts)
                now = above

    @staticmethod
    def _coin(symbols: np.ndarray, step: int) -> np.ndarray:
        mixed = (symbols.astype(np.uint64) + np.uint64(step * 0x51ED2701)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1

    def _push(self, block: bool, symbols: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(starts, append=len(symbols))
        parent = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        self.levels.append((block, symbols, np.append(starts, len(symbols)).astype(np.int32), parent))

    def extend(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from the places a and b on (``back``: from them backwards); a and b differ pairwise.

        All pairs climb together: while both stand at the edge of a parent they move to it, else the rest of one parent is
        compared and left behind.  Where they differ they come down again, past what their symbols share.
        """
        edge, way = (1, -1) if back else (0, 1)
        at = np.arange(len(a))
        x, y = np.asarray(a, np.int64), np.asarray(b, np.int64)
        differ: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for block, symbols, starts, parent in self.levels:
            up_x, up_y = parent[x], parent[y]
            both = (starts[up_x + edge] - edge == x) & (starts[up_y + edge] - edge == y)
            same = both | (symbols[x] == symbols[y])
            on_x, on_y = up_x + np.where(both, 0, way), up_y + np.where(both, 0, way)
            if block:
                rest_x, rest_y = np.abs(starts[up_x + 1 - edge] - x - edge), np.abs(starts[up_y + 1 - edge] - y - edge)
                uneven = same & ~both & (rest_x != rest_y)
                least = np.where(uneven, np.minimum(rest_x, rest_y), 0) * way
                x, y, same = x + least, y + least, same & ~uneven
            differ.append((at[~same], x[~same], y[~same]))
            at, x, y = at[same], on_x[same].astype(np.int64), on_y[same].astype(np.int64)
        if len(at):
            raise ValueError("the two places are one, or the sequence's ends are not unique")
        for h in range(len(self.levels) - 1, -1, -1):
            if h + 1 < len(self.levels) and len(at):
                block, symbols, starts, _ = self.levels[h]
                size = np.minimum(starts[x + 1] - starts[x], starts[y + 1] - starts[y]) if block else 1
                x, y = starts[x + edge].astype(np.int64) - edge, starts[y + edge].astype(np.int64) - edge
                shared = np.where(symbols[x] == symbols[y], size, 0) * way
                x, y = x + shared, y + shared
            at, x, y = (np.concatenate(p) for p in zip((at, x, y), differ[h]))
        out = np.empty(len(a), np.int64)
        out[at] = np.abs(x - np.asarray(a, np.int64)[at])
        return out
