"""Ranked search, periodic runs and HyperMinHash groups against brute force, and on awkward rows."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.llm import catalog, hyperminhash, periodic_runs, signatures
from alarmspan.llm.grammar import Grammar
from test_llm_text import AWKWARD, SCHEMA, SF, none_of


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Ranked search ------------------------------------------------------------------------------------------------------

def slow_search(docs, queries, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, places = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in queries:
        scored = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // places
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


def found(df, queries, k=10):
    return Counter(map(tuple, signatures.ranked_search(df, queries, k).select("item_id", "rank", "doc_id", "score").collect()))


def test_search_equals_scoring_every_document(spark, docs):
    queries = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in queries.collect()], 10)
    assert found(docs, queries) == want


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_DOCS": 8, "SLICE_BYTES": 2000, "HELD_BYTES": 60, "QUERY_ROWS": 3}, {"BITS_A_KEY": 1, "HASHES": 1}])
def test_search_awkward(spark, awkward, monkeypatch, sizes):
    """Small blocks, and signatures so crowded that they hardly exclude anything, give the same lists."""
    for name, value in sizes.items():
        monkeypatch.setattr(signatures, name, value)
    queries = [(1, "stays THE word5x5"), (1, "stays THE word5x5"), (2, None), (3, ""), (None, "the end É"), (4, "a text without an id"), (5, "zzz"),
               (6, "The the the"), (7, LONG_QUERY)]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    docs = [(r[0], r[1]) for r in AWKWARD]
    for k in (1, 10):
        assert found(awkward.repartition(3), asked, k) == slow_search(docs, queries, k)
    assert signatures.ranked_search(none_of(awkward), asked).count() == 0
    assert signatures.ranked_search(awkward, asked.where("1 = 0")).count() == 0


LONG_QUERY = " ".join(f"word{i % 977}x{i}" for i in range(0, 30_000, 7))


def test_bounds_are_never_below_scores(docs):
    texts = [r["text"] for r in docs.limit(100).collect()]
    block = next(signatures._blocks(list(range(len(texts))), texts))
    ids, sizes = block.column(1)[0].as_py(), np.array(block.column(2)[0].as_py())
    terms = sorted({t for d in ids for t in signatures.terms_of(texts[d])})[:500]
    queries = signatures.Queries.of([terms], {t: 7 for t in terms}, 100, int(sizes.sum()), 10)
    best = signatures._Best(queries)
    bits = np.frombuffer(block.column(4)[0].as_py(), np.uint8).reshape(block.column(0)[0].as_py(), -1)
    some, most = signatures.upper_bounds(bits, block.column(0)[0].as_py(), sizes, queries, best.hashes)
    place = {int(t): i for i, t in enumerate(some)}
    exact = 0
    for row, d in enumerate(ids):
        for number, value in best.earned(texts[d], sizes[row]).items():
            bound = most[place[number - 1], row]
            assert bound >= 7 * value
            exact += bound == 7 * value
    assert exact > 0


# Periodic runs ------------------------------------------------------------------------------------------------------

def slow_runs(words, least=24, powers=3):
    smallest = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, powers * q):
                smallest.setdefault((i, j + q), q)
            i = max(j, i + 1)
    runs = sorted(((s, e - s, q) for (s, e), q in smallest.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_grammar_extensions_are_exact():
    rng = np.random.default_rng(1)
    for trial in range(120):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(2, 200))
        if trial % 3 == 0:
            s = np.tile(s[:rng.integers(1, 20)], 30)[:len(s) + 50]
        x = np.concatenate([[100], s, [101]])
        a, b = rng.integers(1, len(s) + 1, (2, 100))
        a, b = a[a != b], b[a != b]
        ahead, back = Grammar(x).extend(a, b), Grammar(x).extend(a, b, back=True)
        for i, j, f, r in zip(a, b, ahead, back):
            assert f == next(n for n in range(len(x)) if x[i + n] != x[j + n])
            assert r == next(n for n in range(len(x)) if x[i - n] != x[j - n])


def test_runs_equal_brute_force(spark, awkward, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [r[1] for r in AWKWARD]
    for _ in range(120):
        w = [str(c) for c in rng.integers(0, rng.integers(1, 5), rng.integers(0, 150))]
        if len(w) and rng.random() < 0.6:
            a, p = rng.integers(0, len(w)), rng.integers(1, 20)
            w = [w[i] if i < a or a + (i - a) % p >= len(w) else w[a + (i - a) % p] for i in range(len(w))]
        texts.append(" \n".join(w))
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, runs string")
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", 5_000)
    for batch in (400, 300_000):
        monkeypatch.setattr(periodic_runs, "BATCH_WORDS", batch)
        got = periodic_runs.periodic_runs(df)
        assert got.columns == ["doc_id", "text", "runs", "runs_", "collapsed"]
        for r in got.collect():
            if len(words_of(texts[r["doc_id"]])) > 5_000:
                continue  # long texts below
            runs, collapsed = slow_runs(words_of(texts[r["doc_id"]]))
            assert [tuple(x) for x in r["runs_"]] == runs and r["collapsed"] == collapsed and r["runs"] == "kept"
    long = {r["text"][:8]: r for r in got.collect() if len(r["text"] or "") > 50_000}
    assert long["word0x0 "]["runs_"] == [] and long["word0x0 "]["collapsed"] == long["word0x0 "]["text"]
    assert [tuple(x) for x in long["the the "]["runs_"]] == [(0, 70_000, 1)] and long["the the "]["collapsed"] == "the end"
    assert periodic_runs.periodic_runs(none_of(awkward)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, least_powers=2)


def test_periodic_runs_query(spark, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: r for r in catalog.op12_periodic_runs(spark, SF).collect()}
    several = 0
    for d, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, collapsed = slow_runs(words)
        several += len(runs) > 0
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want = [len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
                sha(collapsed)]
        assert [got[d][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")] == want
    assert several > 5


# HyperMinHash groups ------------------------------------------------------------------------------------------------

def slow_groups(rows, width, least):
    """(doc_id, set size, smallest named doc_id of the group) per row, by comparing every two sets."""
    sets = []
    for _, text in rows:
        w = words_of(lowered(text))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 1000 * shared >= 1000 * least * (len(a) + len(sets[j]) - shared):
                group[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)] = min(names.get(root(i), d), d)
    return Counter((d, len(s), names.get(root(i)), names.get(root(i)) is None or d == names.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def grouped(df, width=2, least=0.8):
    out = hyperminhash.near_duplicate_groups(df, width, least)
    return Counter(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_groups_equal_brute_force(spark, docs):
    want = slow_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 2, 0.8)
    assert grouped(docs) == want and any(d != c for d, _, c, _ in want)


@pytest.mark.parametrize("rows, shipped", [(256, 500_000), (2, 0)])
def test_groups_of_all_sizes(spark, awkward, monkeypatch, rows, shipped):
    """Sets from one shingle to thousands, with as many changes as still link and one more, in large and in tiny blocks."""
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(hyperminhash, "SHIPPED_PLACES", shipped)
    rng = np.random.default_rng(3)
    texts = [(r[0], r[1]) for r in AWKWARD]
    for n in (1, 2, 3, 5, 6, 9, 14, 20, 27, 29, 56, 60, 113, 223, 450, 880, 910, 2000):
        base = [f"w{n}x{i}" for i in range(n)]
        for most in (n // 20, n // 19, n // 10):
            for _ in range(2):
                changed = list(base)
                for i in rng.choice(n, most, replace=False):
                    changed[i] = f"new{rng.integers(1 << 40)}"
                texts.append((len(texts) + 100, " ".join(changed)))
        texts += [(len(texts) + 100, " ".join(base)), (len(texts) + 101, " ".join(base).upper()), (None, " ".join(base))]
    df = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, node string, class int")
    assert grouped(df) == slow_groups(texts, 2, 0.8)
    assert grouped(none_of(df)) == Counter()


def test_sketch_estimates_are_close():
    rng = np.random.default_rng(4)
    for n in (40, 300, 3000):
        c = hyperminhash.sketch_class(n)
        for share in (1.0, 0.8, 0.4, 0.0):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            both = int(2 * n * share / (1 + share))
            b = np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both).astype(np.uint64)])
            sketch = [hyperminhash.compressed(hyperminhash.minima(h, c))[None] for h in (a, b)]
            j, used = hyperminhash.estimates(*sketch, np.array([n]), np.array([n]), c)
            assert abs(j[0, 0] - both / (2 * n - both)) < 6 * math.sqrt(0.25 / used[0, 0]) + 0.01
