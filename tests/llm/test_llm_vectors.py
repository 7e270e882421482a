"""Vector searches against brute force, and on awkward rows."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.llm import ann, exact_topk

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string, block long")


def slow_products(rows, wanted, most, scale=64):
    ok = [(i, np.floor(scale * np.array(v, dtype=float)).astype(int)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if wanted(q):
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:most]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_products_with_ties_lengths_and_gaps(spark, block, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(block)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 4])).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i % 4][1]) for i in range(30)] + [(300, [0.0] * 6), (301, None), (302, []), (303, [1.0, None] * 3),
             (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6), (306, [1.0, 2.0]), (310, [3.0, -1.0])]
    df = frame(spark, [(i, v, 1, "x", 2) for i, v in rows])
    got = exact_topk.largest_products(df, df.where("vec_id % 10 = 0"), 9).collect()
    assert sorted(map(tuple, got)) == slow_products(rows, lambda q: q % 10 == 0, 9)
    none = df.where("1 = 0")
    assert exact_topk.largest_products(none, none).count() == exact_topk.largest_products(df, none).count() == 0


def test_neighbours_are_exact_on_few_vectors_and_recalled_on_many(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert all(abs(d[ids == i][0] - s) < 1e-12 for i, s in found.values())
        assert list(found[k][1] for k in sorted(found)) == sorted(s for _, s in found.values())
        hits += len({ids[i] for i in order} & {i for i, _ in found.values()})
    assert len(got) == sum(ids % 10 == 0) and hits / (10 * len(got)) >= 0.95


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 2.0])]
    df = frame(spark, [(i, v, 1, "x", 2) for i, v in rows])
    got = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 100 = 0"), 2).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (100, 1, 8, 1.0)]
    none = df.where("1 = 0")
    assert ann.nearest(none, none).count() == ann.nearest(df, none).count() == 0


del F


def test_query_rows_that_repeat_get_their_list_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = spark.createDataFrame([rows[3], rows[3], rows[4]], df.schema)
    for got, once in ((exact_topk.largest_products(df, twice, 7), exact_topk.largest_products(df, df.where("vec_id = 3"), 7)),
                      (ann.nearest(df, twice, 7), ann.nearest(df, df.where("vec_id = 3"), 7))):
        got, want = got.where("query_id = 3").collect(), sorted(map(tuple, once.collect()))
        assert sorted(map(tuple, got)) == sorted(want * 2) and len(want) == 7


def test_large_products_are_exact_and_larger_ones_take_no_part(spark):
    rows = [(1, [3e7, 1.0]), (2, [3e7, 2.0]), (3, [1e17, 0.0]), (4, [1e300, 1.0]), (5, [-2e7, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in exact_topk.largest_products(df, df, 9).collect()}
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i in (1, 2, 5)}
    assert got == {(a, b): sum(x * y for x, y in zip(whole[a], whole[b])) for a in whole for b in whole if a != b}
