"""Properties of detectors, ensembles and attributions."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmspan.detectors import forest, pca, rff, statistical
from alarmspan.detectors.base import build_detectors
from alarmspan.layout import Layout
from alarmspan.operators import uncertainty
from alarmspan.operators.ordered import with_position
from alarmspan.plans import evaluate

T0 = dt.datetime(2024, 1, 1)
LAY = Layout(max_rows=1000)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    rows, planted = [], []
    for s in ("a", "b"):
        x = rng.normal(size=(150, 6)) @ np.diag([3, 2, 1, 1, .5, .5])
        x[140:145] += 25
        for i, r in enumerate(x):
            rows.append((s, T0 + dt.timedelta(minutes=i), [float(v) for v in r]))
        planted.append(x)
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, features array<double>")
    return evaluate.split_rows(with_position(df, LAY)).cache(), dict(zip("ab", planted))


def scores(df, s="a", split="test"):
    rows = df.where((F.col("series_id") == s) & (F.col("split") == split)).orderBy("ts").select("score").collect()
    return np.array([r[0] for r in rows])


def test_three_sigma_golden(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), i, "train", i, 4, [float(x), float(y)]) for i, (x, y) in enumerate([(3, 4), (6, 8), (0, 5), (5, 12)])]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, pos bigint, split string, split_pos bigint, split_n bigint, features array<double>")
    got = scores(statistical.three_sigma("features").score_splits(df, LAY), split="train")
    assert np.allclose(got, [.95065415, .51189070, .95065415, 1.38941761])
    wide = df.select("*", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    assert np.allclose(scores(evaluate.closed_form_scores(wide, LAY, ["x", "y"], ("three_sigma",)), split="train"), got)


def test_detector_protocol_equals_closed_form_plan(cloud):
    df, _ = cloud
    for det, name in ((statistical.three_sigma("features"), "three_sigma"), (statistical.ewma_chart("features"), "ewma")):
        a = scores(det.score_splits(df, LAY))
        b = scores(evaluate.closed_form_scores(df, LAY, "features", (name,)))
        assert np.allclose(a, b)


@pytest.mark.parametrize("lay", [LAY, Layout(block_rows=40)])
def test_t2_equals_eigen_decomposition(cloud, lay):
    df, raw = cloud
    got = scores(pca.hotelling_t2(n_components=3).score_splits(df, lay))
    x = raw["a"]
    train, test = x[:75], x[90:]
    mu = train.mean(axis=0)
    vals, vecs = np.linalg.eigh(np.cov((train - mu).T, bias=True))
    top = np.argsort(vals)[::-1][:3]
    assert np.allclose(got, (((test - mu) @ vecs[:, top] / np.sqrt(vals[top])) ** 2).sum(axis=1))


@pytest.mark.parametrize("limit", [(("features",), 7, 0), (("features",), 7, 10**9)])
def test_chunks_do_not_change_scores(cloud, monkeypatch, limit):
    """Shipped parameters, co-grouped parameters and any chunk size score alike."""
    df, _ = cloud
    det = forest.isolation_forest(n_estimators=20)
    whole = scores(det.score_splits(df, LAY))
    from alarmspan.detectors import chunks
    monkeypatch.setattr(chunks.per_chunk, "__defaults__", limit)
    assert np.allclose(scores(det.score_splits(df, LAY)), whole)


def test_forest(cloud):
    df, _ = cloud
    det = forest.isolation_forest(n_estimators=60)
    scored = det.score_splits(df, LAY).cache()
    for s in "ab":
        v = scores(scored, s)
        assert (v > -0.5).all() and (v <= 0.5).all()
        assert set(np.argsort(v)[-5:]) == set(range(50, 55))
    again = scores(det.score_splits(df, LAY))
    assert np.allclose(again, scores(scored))


def test_forest_draws_are_distinct_and_bounded(spark):
    df = spark.range(5000).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"))
    drawn = forest.draw_rows(df, LAY, 5, 256, 1).groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d")).collect()
    assert len(drawn) == 5 and all(r.n == r.d == 256 for r in drawn)
    small = forest.draw_rows(df.where("pos < 100"), LAY, 3, 256, 1).groupBy("tree").count().collect()
    assert all(r["count"] == 100 for r in small)


def test_draws_reach_every_row_alike(spark):
    df = spark.range(1009 + 4).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"))  # not a prime
    drawn = forest.draw_rows(df, LAY, 400, 64, 7)
    assert drawn.groupBy("tree").agg(F.count_distinct("pos").alias("d")).where("d != 64").count() == 0
    times = {r["pos"]: r["count"] for r in drawn.groupBy("pos").count().collect()}
    assert len(times) == 1013 and max(times.values()) < 60 and abs(np.mean([times[p] for p in range(1009, 1013)]) - 400 * 64 / 1013) < 12
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_largest_primes():
    assert [forest.prime_below(n) for n in (2, 3, 4, 10, 97, 100, 7919, 2 ** 31, 2 ** 61)] == [2, 3, 3, 7, 97, 97, 7919, 2 ** 31 - 1, 2 ** 61 - 1]


def test_packed_forest_scores_like_its_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x[7, 2] = np.nan
    grown = [forest._grow(x[rng.choice(300, 64, replace=False)], np.random.default_rng(i), 6) for i in range(9)]

    def depth(row, t, node=0):
        while t["feature"][node] >= 0:
            node = t["left"][node] if row[t["feature"][node]] <= t["cut"][node] else t["right"][node]
        return t["depth"][node] + float(forest.expected_depth(t["cover"][node]))
    want = [np.mean([depth(r, t) for t in grown]) for r in x]
    import pandas as pd
    assert np.allclose(forest._mean_depth(x, pd.DataFrame(grown), block=70), want)


def test_attribution_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    grown = forest._grow(x, np.random.default_rng(5), 6)
    got = forest.tree_contributions(x[:6], grown)
    feature, cut, left, right, cover, depth = (grown[c] for c in ("feature", "cut", "left", "right", "cover", "depth"))
    from itertools import combinations
    from math import factorial

    def value(row, known, node=0):
        if feature[node] < 0:
            return depth[node] + float(forest.expected_depth(cover[node]))
        if feature[node] in known:
            return value(row, known, left[node] if row[feature[node]] <= cut[node] else right[node])
        return sum(cover[c] / cover[node] * value(row, known, c) for c in (left[node], right[node]))

    for i in range(6):
        for j in range(4):
            rest = [k for k in range(4) if k != j]
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / factorial(4) * (value(x[i], {*s, j}) - value(x[i], set(s)))
                       for size in range(4) for s in combinations(rest, size))
            assert got[i, j] == pytest.approx(want, abs=1e-9)


def test_attributions_of_many_trees_are_the_trees_sums():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5))
    x[3, 1] = np.nan  # goes above every cut, as in scoring
    grown = [forest._grow(x[rng.choice(np.arange(4, 200), 64, replace=False)], np.random.default_rng(i), 6) for i in range(7)]
    grown.append(forest._grow(x[5:6], np.random.default_rng(1), 1))  # a tree that is one leaf
    import pandas as pd
    total, length, base = forest.path_contributions(x, forest.path_tables(pd.DataFrame(grown)), block=64)
    assert np.allclose(total, sum(forest.tree_contributions(x, t) for t in grown))
    assert np.allclose(length / len(grown), forest._mean_depth(x, pd.DataFrame(grown)))
    assert np.allclose(total.sum(axis=1) + base, length)
    alone, _, at = forest.path_contributions(x, forest.path_tables(pd.DataFrame(grown[-1:])))
    assert not alone.any() and at == 0.0


def test_attribution_sums_to_path_length(cloud, monkeypatch):
    df, _ = cloud
    trees = forest.isolation_forest(n_estimators=15).fit(df.where("split = 'train'").withColumn("pos", F.col("split_pos")), LAY)
    rows = forest.sample_rows(df.where("split = 'test'"), LAY, 20)
    out = forest.forest_attribution(rows, trees, LAY, chunk_rows=8).toPandas()
    assert len(out) == 40
    assert np.allclose(out.contributions.map(sum) + out.base, out.path_length)
    # Path tables too large to ship meet chunks of rows: the same values.
    per_chunk, shipped = forest.per_chunk, out.sort_values(["series_id", "ts"])
    with monkeypatch.context() as patch:
        patch.setattr(forest, "per_chunk", lambda *a, **k: per_chunk(*a, **{**k, "ship_bytes": 0}))
        met = forest.forest_attribution(rows, trees, LAY, chunk_rows=8).toPandas().sort_values(["series_id", "ts"])
    assert np.allclose(np.vstack(met.contributions), np.vstack(shipped.contributions), atol=1e-12)
    top = forest.top_contributions(forest.forest_attribution(rows, trees, LAY), LAY, [f"x{i}" for i in range(6)], top=3)
    assert top.count() == 120 and top.where("rank > 3").count() == 0


def test_one_class_model_reports_its_gap(spark):
    """The gap bounds the distance to the best boundary, found here with far more passes; an offset changes nothing."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    make = lambda m: spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(m)],
                                           "series_id string, pos bigint, features array<double>")
    few = rff.one_class_svm(nu=0.2, dim=32, passes=12, tolerance=0.05).fit(make(x), LAY).first()
    many = rff.one_class_svm(nu=0.2, dim=32, passes=25, tolerance=1e-4).fit(make(x), LAY).first()
    size = lambda r: float(np.dot(r["w"], r["w"]))
    assert many["gap"] <= few["gap"] and size(many) <= size(few) * (1 + 1e-9)
    # |w|^2 of any iterate is above the least one by twice its gap at most.
    assert size(few) * (1 - 2 * few["gap"]) <= size(many) * (1 + 1e-9)
    far = make(x + 1e7).groupBy("series_id").agg(rff.cell_variance("features").alias("v")).first()["v"]
    assert np.isclose(far, x.var(), rtol=1e-6)


def test_one_class_boundary(cloud):
    df, _ = cloud
    scored = rff.one_class_svm(nu=0.1, passes=4).score_splits(df, LAY).cache()
    train, test = scores(scored, split="train"), scores(scored)
    assert 0.02 <= (train > 0).mean() <= 0.2
    assert (test[50:55] > 0).all() and test[50:55].min() > np.median(test)


def test_sequence_error(cloud):
    df, raw = cloud
    scored = pca.sequence_ae(seq_len=3, latent_dim=4).score_splits(df, LAY)
    v = scores(scored)
    assert len(v) == 60 and v[0] == v[1] == v.min() and v[50:55].min() > np.median(v) * 5
    x = raw["a"]
    lo, hi = x[:75].min(axis=0), x[:75].max(axis=0)
    seq = lambda m: np.stack([m[i:i + 3].ravel() for i in range(len(m) - 2)])
    tr, te = seq((x[:75] - lo) / (hi - lo)), seq((x[90:] - lo) / (hi - lo))
    mu = tr.mean(axis=0)
    vals, vecs = np.linalg.eigh(np.cov((tr - mu).T, bias=True))
    axes = vecs[:, np.argsort(vals)[::-1][:4]]
    rest = (te - mu) - (te - mu) @ axes @ axes.T
    assert np.allclose(v[2:], (rest ** 2).mean(axis=1))


def test_bootstrap(cloud):
    df, _ = cloud
    det = statistical.three_sigma("features")
    train = df.where("split = 'train'")
    drawn = uncertainty.bootstrap_rows(train, LAY, 4)
    assert {r["count"] for r in drawn.groupBy("series_id", "b").count().collect()} == {75}
    distinct = drawn.groupBy("series_id", "b").agg(F.count_distinct("split_pos").alias("d")).collect()
    assert all(35 < r.d < 60 for r in distinct)  # about 63 % of 75 rows
    params = uncertainty.bootstrap_fit(det, train, LAY, 4)
    rows = df.where("split = 'test'").withColumn("pos", F.col("split_pos"))
    ci = uncertainty.bootstrap_interval(uncertainty.bootstrap_scores(det, params, rows, LAY, 4), LAY).orderBy("series_id", "ts").toPandas()
    assert ((ci.lower <= ci.mean_score + 1e-9) & (ci.mean_score <= ci.upper + 1e-9)).all()
    from alarmspan.functions.stats import l2_norm
    fast = uncertainty.weighted_moments_interval(df, LAY, l2_norm("features"), 4).where("split = 'test'").orderBy("series_id", "ts").toPandas()
    for c in ("mean_score", "lower", "upper"):
        assert np.allclose(ci[c], fast[c], rtol=1e-6)


def test_conformal_around_a_detector_and_unknown_names(cloud):
    df, _ = cloud
    scored = uncertainty.conformal_calibrate(forest.isolation_forest(n_estimators=10), df, LAY)
    p = uncertainty.conformal_pvalues(scored, LAY).toPandas()
    assert p.p_value.between(0, 1).all()
    for _, g in p.groupby("series_id"):
        assert (g.sort_values("score").p_value.diff().dropna() <= 1e-12).all()
    assert [d.short_name for d in build_detectors(("three_sigma", "nope", "ewma"), "features")] == ["three_sigma", "ewma"]


def test_failing_method_is_skipped(cloud):
    from dataclasses import replace
    df, _ = cloud
    good = statistical.three_sigma("features")
    def broken(rows, params, lay):
        raise RuntimeError("no")
    out = evaluate.model_scores(df, LAY, [good, replace(good, short_name="bad", score=broken)])
    assert [r[0] for r in out.select("method").distinct().collect()] == ["three_sigma"]


def test_a_failing_or_unknown_method_fails_whole_comparisons(cloud, spark, monkeypatch):
    from alarmspan.config import ExperimentConfig, ModelConfig, SamplingConfig
    from alarmspan.detectors import base
    from alarmspan.plans import pipeline, sweeps

    def broken(features, **params):
        def fit(train, lay):
            raise RuntimeError("no")
        return base.Detector("broken", "broken", fit, None)
    build_detectors((), "features")  # registers the others
    monkeypatch.setitem(base._FACTORIES, "broken", broken)
    df, _ = cloud
    runs = df.select("series_id").distinct().withColumn("failure_time", F.timestamp_seconds(F.lit(10 ** 9)))
    rows = spark.range(200).select(F.lit(1).cast("long").alias("series_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
                                   F.rand(3).alias("value"), F.timestamp_seconds(F.lit(12_000)).alias("failure_time"))
    for name, err in (("broken", RuntimeError), ("nope", ValueError)):
        with pytest.raises(err, match=name):
            sweeps.sampling_sweep(rows, LAY, ["value"], SamplingConfig(factors=(1,), modes=("decimate",)), methods=("three_sigma", "hotelling_t2", name))
        with pytest.raises(err, match=name):
            pipeline.compare_methods(df, LAY, runs, ExperimentConfig(models=ModelConfig(methods=("three_sigma", name))))
