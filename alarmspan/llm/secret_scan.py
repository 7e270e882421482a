"""Secrets in texts: fixed patterns, and runs of characters that a battery of randomness tests takes for random keys."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.session import cut_lineage

# Fixed patterns; a match counts if the part named holds so many characters.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

# Runs long enough to test.  Access and hex matches that count lie inside one.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
# Alphabets in the order they are inferred; the first that holds all characters of a run is its encoding.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "lower36": _DIGITS + _LOWER,
             "upper36": _DIGITS + _UPPER, "alnum62": _DIGITS + _UPPER + _LOWER, "base64": _DIGITS + _UPPER + _LOWER + "+/",
             "base64url": _DIGITS + _UPPER + _LOWER + "-_"}
LENGTHS = (16, 20, 24, 32, 40, 64)  # where strata of length begin
FALSE_SHARE = 0.05
STEPS = 200                         # resolution of a combined p-value
LEAST_IN_STRATUM = 20


def encoding(run: str) -> str | None:
    """Encoding of a run; None for letters only or digits only, which words and numbers are."""
    if run.isalpha() or run.isdigit():
        return None
    letters = set(run)
    return next((name for name, alphabet in ALPHABETS.items() if letters <= _members(alphabet)), None)


@lru_cache(maxsize=None)
def _members(alphabet: str) -> frozenset:
    return frozenset(alphabet)


def randomness(run: str, alphabet: str) -> float:
    """Combined p-value of three tests of "drawn evenly from the alphabet": small for patterns, even for random runs.

    Chi-squared on the symbols in equal ranges of two expected each; runs above and below the middle of the alphabet;
    correlation of neighbours.  Joined by Fisher's method.
    """
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in run], dtype=np.float64)
    n, k = len(x), len(alphabet)
    bins = max(2, min(k, n // 2))
    seen = np.bincount((x * bins // k).astype(int), minlength=bins)
    sizes = np.bincount((np.arange(k) * bins // k), minlength=bins) * n / k
    p_even = chi2_tail(float(((seen - sizes) ** 2 / sizes).sum()), bins - 1)
    high = x >= k / 2
    a = int(high.sum())
    if 0 < a < n:
        mean = 2 * a * (n - a) / n + 1
        spread = math.sqrt(max(1e-12, (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread / math.sqrt(2))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - (k - 1) / 2
    correlation = float((d[1:] * d[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    p_serial = math.erfc(abs(correlation) / math.sqrt(2))
    return chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (p_even, p_runs, p_serial)), 6)


def chi2_tail(x: float, freedom: int) -> float:
    """Probability of a chi-squared value above x: the finite series for even and odd degrees of freedom."""
    half = x / 2
    if freedom % 2:
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        for i in range(1, (freedom + 1) // 2):
            total += term
            term *= half / (i + 0.5)
        return min(1.0, total)
    total, term = 0.0, math.exp(-half)
    for i in range(freedom // 2):
        total += term
        term *= half / (i + 1)
    return min(1.0, total)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Pattern spans (start, kind, end), sorted; tested runs (start, end, stratum, score, decoy's score, hash).

    A decoy is ordinary text of the same length: the Latin letters that stand around the run, in lower case.  Its score
    says how random such text looks to the battery at that length; -1 where a text has too few letters.
    """
    base, runs = [], []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for run in _RUN.finditer(text):
        start, word = run.start(), run.group()
        if "AKIA" in word:
            base += [(start + m.start(), 1, start + m.end()) for m in _ACCESS.finditer(word) if m.end() - m.start() >= LEAST_ACCESS]
        base += [(start + m.start(), 2, start + m.end()) for m in _HEX.finditer(word) if m.end() - m.start() >= LEAST_HEX]
        kind = encoding(word)
        if kind is None:
            continue
        around = text[max(0, start - 4 * len(word)):start] + text[run.end():run.end() + 4 * len(word)]
        decoy = "".join(c for c in around.lower() if "a" <= c <= "z")[:len(word)]
        score = randomness(word, ALPHABETS[kind])
        decoy_score = randomness(decoy, _LOWER) if len(decoy) == len(word) else None
        runs.append((start, run.end(), sum(len(word) >= x for x in LENGTHS) - 1, int(score * STEPS),
                     -1 if decoy_score is None else int(decoy_score * STEPS), xxhash.xxh64_intdigest(word) >> 1))
    return sorted(base), runs


def cuts(found: DataFrame, runs: str) -> dict[int, int]:
    """Per stratum of length, the smallest score from which at most FALSE_SHARE of the runs are expected to be ordinary text.

    The share is (decoys at or above the score + 1) over the runs at or above it, each distinct run counted once.  A stratum
    with few runs borrows those of shorter strata, whose decoys look more random; where the share cannot be shown to be
    small, no run passes.  Counts per stratum and score, at most strata times steps, reach the driver.
    """
    one = found.select(F.explode(runs).alias("r")).select("r.*").groupBy("hash").agg(
        F.min("stratum").alias("stratum"), F.min("score").alias("score"), F.max("decoy").alias("decoy"))
    counted = one.select("stratum", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("score").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("decoy").alias("at"))
    )).alias("e")).where("e.at >= 0").groupBy("stratum", "e.kind", "e.at").count().collect()
    table = np.zeros((len(LENGTHS), 2, STEPS + 1))
    for r in counted:
        table[r["stratum"], r["kind"], r["at"]] += r["count"]
    out = {}
    for s in range(len(LENGTHS)):
        first = s
        while first > 0 and table[first:s + 1, 0].sum() < LEAST_IN_STRATUM:
            first -= 1
        own = table[first:s + 1].sum(0)
        above = own[:, ::-1].cumsum(axis=1)[:, ::-1]
        good = np.flatnonzero((above[1] + 1) / np.maximum(above[0], 1) <= FALSE_SHARE)
        out[s] = max(1, int(good[0])) if len(good) else STEPS + 1
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base (the pattern spans) and spans (all), both as kind:start:end joined by
    commas, by start and then kind; code points, end exclusive.

    Patterns are matched from the left without overlap, per kind; an assignment's span is its whole match.  ``random`` spans
    are tested runs at or above their length's cut that touch no pattern span.  Null and empty texts have no spans; rows
    are scanned one by one, so null or repeated doc_ids keep their rows; an empty table gives no rows; other columns are
    ignored.  The scanned spans, not texts, are written between the two passes.
    """
    ident, base, runs = "doc_id", "base", "runs"

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                spans, tested = scan(t or "")
                free = []
                for run in tested:
                    free.append(not any(b < run[1] and run[0] < e for b, _, e in spans))
                rows.append(([dict(zip(("start", "kind", "end"), s)) for s in spans],
                             [dict(zip(("start", "end", "stratum", "score", "decoy", "hash", "free"), (*r, f))) for r, f in zip(tested, free)]))
            yield pd.DataFrame(rows, columns=["base", "runs"])

    read = F.pandas_udf(scanned, "base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,"
                                 "stratum:int,score:int,decoy:int,hash:long,free:boolean>>")
    found = cut_lineage(docs.select(F.col(doc_id).cast("long").alias(ident), read(F.col(text)).alias("found"))
                            .select(ident, F.col("found.base").alias(base), F.col("found.runs").alias(runs)), "secret-spans")
    cut = cuts(found, runs)
    least = F.array(*[F.lit(cut[s]) for s in range(len(LENGTHS))])
    random = F.transform(F.filter(F.col(runs), lambda r: r["free"] & (r["score"] >= F.element_at(least, r["stratum"] + 1))),
                         lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.withColumn("random", random).select(
        F.col(ident).alias("doc_id"), *[count(F.col(base), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.size("random").cast("long").alias("n_random"), joined(F.col(base)).alias("base"),
        joined(F.array_sort(F.concat(F.col(base), F.col("random")))).alias("spans"))
