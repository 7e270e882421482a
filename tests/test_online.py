"""The online alarm over rows that come late, across triggers, against the fold of all rows in time order."""
import os
import shutil

import numpy as np
import pandas as pd
import pytest

from alarmspan.streaming import online


def write_files(spark, folder, frames):
    """One Parquet file per frame, taken in this order by a file stream."""
    os.makedirs(folder)
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf).coalesce(1).write.parquet(f"{folder}/p{i}")
        src = next(f for f in os.listdir(f"{folder}/p{i}") if f.endswith(".parquet"))
        shutil.move(f"{folder}/p{i}/{src}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i * 60,) * 2)
        shutil.rmtree(f"{folder}/p{i}")


def wanted(pdf, rule=online.AlarmRule()):
    """Row by row, as the docstring says."""
    out = []
    for key, g in pdf.sort_values(["ts", "score"], na_position="last").groupby("series_id"):
        mean = var = None
        run, start = 0, pd.NaT
        for n, r in enumerate(g.itertuples(), 1):
            if np.isfinite(r.score):
                mean = r.score if mean is None else rule.lam * r.score + (1 - rule.lam) * mean
                var = 0.0 if var is None else rule.lam * (r.score - mean) ** 2 + (1 - rule.lam) * var
            hit = np.isfinite(r.score) and r.score > r.threshold
            run, start = (run + 1, start if run else r.ts) if hit else (0, pd.NaT)
            out.append((key, n, r.ts, mean, var, run, start, run >= rule.persistence))
    return pd.DataFrame(out, columns=["series_id", "row", "ts", "ewma_mean", "ewma_var", "run", "run_start", "alarm"])


def readings():
    rng = np.random.default_rng(4)
    n = 600
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40 * 3600, n)), unit="s")
    score = rng.normal(1, 1, n)
    score[rng.choice(n, 12, replace=False)] = np.nan
    return pd.DataFrame({"series_id": rng.choice(["a", "b", "c"], n), "ts": ts, "score": score, "threshold": 0.8})


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Rows up to 50 minutes late, so that files overlap in time, as a stream of 8 triggers."""
    pdf = readings()
    came = pdf.ts + pd.to_timedelta(np.random.default_rng(5).integers(0, 3000, len(pdf)), unit="s")
    arrived = pdf.iloc[np.argsort(came.to_numpy(), kind="stable")].reset_index(drop=True)
    folder = str(tmp_path_factory.mktemp("late") / "in")
    write_files(spark, folder, [arrived.iloc[i:i + 75] for i in range(0, len(arrived), 75)])
    assert (arrived.ts.iloc[75:150].min() < arrived.ts.iloc[:75].max())
    stream = online.file_stream(spark, folder, "*.parquet", 1)
    return pdf, spark.read.parquet(f"{folder}/*.parquet"), online.run_available(online.online_alarm(stream), "t-late")


def same(got, want):
    got = got.sort_values(["series_id", "row"]).reset_index(drop=True)[list(want.columns)]
    assert (got.ts.astype("datetime64[us]") == want.ts.astype("datetime64[us]")).all()
    for c in ("ewma_mean", "ewma_var"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)
    for c in ("series_id", "row", "run", "alarm"):
        assert (got[c] == want[c]).all(), c
    assert (got.run_start.astype("datetime64[us]").fillna(pd.Timestamp(0)) == want.run_start.astype("datetime64[us]").fillna(pd.Timestamp(0))).all()


def test_rows_late_across_triggers_give_the_batch_result(late):
    pdf, stored, out = late
    rest = online.close_alarm(stored, out)
    assert out.count() > 500 and rest.count() > 0 and out.count() + rest.count() == len(pdf)
    same(out.unionByName(rest).toPandas(), wanted(pdf))


def test_small_pieces_merge_to_the_same_rows(spark, late, tmp_path, monkeypatch):
    """A trigger's rows in many pieces, some of which lie partly behind the watermark."""
    monkeypatch.setattr(online.OrderedAlarm, "piece_rows", 7)
    pdf, stored, _ = late
    write_files(spark, str(tmp_path / "in"), [pdf.iloc[i::3] for i in range(3)])
    stream = online.file_stream(spark, str(tmp_path / "in"), "*.parquet", 2)
    out = online.run_available(online.online_alarm(stream, delay="2 days"), "t-pieces")
    early = online.run_available(online.online_alarm(online.file_stream(spark, str(tmp_path / "in"), "*.parquet"), delay="5 hours"), "t-early")
    assert out.count() == 0 and 400 < early.count() < len(pdf)
    for got in (out, early):
        same(got.unionByName(online.close_alarm(stored, got)).toPandas(), wanted(pdf))


def test_closing_alone_is_the_batch_result(late):
    pdf, stored, out = late
    same(online.close_alarm(stored, out.limit(0)).toPandas(), wanted(pdf))


def test_the_session_keeps_its_state_store(spark, late):
    assert "RocksDB" not in str(spark.conf.get(online._STORE, None))


def test_a_silent_series_is_forgotten_and_later_rows_dropped(spark, tmp_path):
    at = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    make = lambda rows: pd.DataFrame(rows, columns=["series_id", "ts", "score", "threshold"])
    files = [make([("a", at(0), 2.0, 1.0), ("b", at(0), 2.0, 1.0)]), make([("b", at(10), 2.0, 1.0)]),
             make([("b", at(30), 2.0, 1.0)]), make([("a", at(31), 2.0, 1.0), ("a", at(2), 9.0, 1.0)]), make([("b", at(60), 2.0, 1.0)]),
             make([("b", at(90), 2.0, 1.0)])]
    write_files(spark, str(tmp_path / "in"), files)
    stream = online.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    out = online.run_available(online.online_alarm(stream, forget_seconds=20 * 3600), "t-forget").toPandas()
    a = out[out.series_id == "a"].sort_values("ts")
    assert a.row.tolist() == [1, 1] and a.run.tolist() == [1, 1]  # begun anew; the row of hour 2 came after the watermark
    assert 9.0 not in out.score.tolist()
    b = out[out.series_id == "b"].sort_values("ts")
    assert b.row.tolist() == [1, 2, 3, 1]
    stored = spark.read.parquet(f"{tmp_path}/in/*.parquet").where("score < 9")
    whole = online.close_alarm(stored, spark.createDataFrame(out).limit(0), forget_seconds=20 * 3600).toPandas()
    assert whole.sort_values(["series_id", "ts"]).row.tolist() == [1, 1, 1, 2, 3, 1, 1]


def test_a_short_series_costs_one_reading_and_one_writing_a_trigger():
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def getMapState(self, name, key, value):
            return None  # pieces are not touched

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 3

    rows = pd.DataFrame({"us": [4000, 1000, 2000], "score": [3.0, 1.0, 2.0], "limit": [0.5] * 3})
    alarm = online.OrderedAlarm("series_id", online.AlarmRule())
    alarm.init(Handle())
    assert not list(alarm.handleInputRows((1,), iter([rows]), Times())) and sorted(calls) == ["get", "timer", "update"]
    out = pd.concat(alarm.handleExpiredTimer((1,), Times(), None))
    assert out["us"].tolist() == [1000, 2000] and sorted(calls[3:]) == ["get", "timer", "update"]
