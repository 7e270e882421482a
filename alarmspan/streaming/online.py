"""Streaming twins: tumbling means, sliding-window features, online smoothed limit and causal persistent alarm."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alarmspan.functions.stats import EPS
from alarmspan.operators.features import BUILDERS, PREFIX
from alarmspan.session import scratch_path


def stream_resample(stream: DataFrame, cols: Sequence[str], width: str, delay: str, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Mean per tumbling window once the watermark has passed it; later rows are dropped."""
    late = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return (late.groupBy(key, F.window(ts, width).alias("_w")).agg(*[F.avg(c).alias(c) for c in cols])
                .select(key, F.col("_w.start").alias(ts), *cols))


def stream_features(stream: DataFrame, col: str, width: str, slide: str, delay: str, features: Sequence[str],
                    key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Window statistics over sliding time windows, the time-based counterpart of the row windows."""
    late = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    aggs = [BUILDERS[f](F.col(col)).alias(PREFIX[f]) for f in features]
    return (late.groupBy(key, F.window(ts, width, slide).alias("_w")).agg(F.count(col).alias("n_rows"), *aggs)
                .select(key, F.col("_w.start").alias("start_ts"), F.col("_w.end").alias("end_ts"), "n_rows", *[PREFIX[f] for f in features]))


def close_windows(rows: DataFrame, windowed: Callable[[DataFrame], DataFrame], width: str, delay: str, end: Column,
                  ts: str = "ts") -> DataFrame:
    """The windows that an append-mode stream over the same input leaves open when it ends, by the same aggregation
    (``windowed``): those that end after the watermark.

    The latest time, one value, decides where that is, so that only the last ``width`` before it is read.
    """
    # A watermark is kept in milliseconds.
    mark = rows.agg((F.timestamp_millis(F.unix_millis(F.max(ts))) - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
    if mark is None:
        return windowed(rows)
    mark = F.lit(mark).cast("timestamp")
    return windowed(rows.where(F.col(ts) > mark - F.expr(f"INTERVAL {width}"))).where(end > mark)


def smoothed(values: np.ndarray, known: np.ndarray, lam: float, start: float | None) -> np.ndarray:
    """x_t = lam v_t + (1 - lam) x_(t-1) over known values, from ``start`` or the first known value; held where unknown.

    Blocks short enough for powers of the decay to stay in range, each in closed form by a running sum.
    """
    out, decay = np.full(len(values), np.nan), 1.0 - lam
    picked = values[known]
    made = np.empty(len(picked))
    size = len(picked) if decay <= 0 else max(1, int(200 / -np.log(decay)))
    state = start
    for a in range(0, len(picked), max(1, size)):
        part = picked[a:a + size]
        if decay <= 0:
            made[a:a + size] = part
            continue
        powers = decay ** np.arange(1, len(part) + 1)
        weights = np.full(len(part), lam)
        if state is None:
            weights[0], state = 1.0, 0.0
        made[a:a + size] = powers * (state + np.cumsum(weights * part / powers))
        state = made[a:a + size][-1]
    out[known] = made
    before = np.cumsum(known) - 1
    held = np.where(before >= 0, made[np.maximum(before, 0)] if len(made) else np.nan, np.nan if start is None else start)
    return np.where(known, out, held)


@dataclass(frozen=True)
class AlarmRule:
    """Smoothing weight, width of the moving limit in deviations, scores above the limit in a row that make an alarm, and
    the silence in microseconds after which a series begins anew."""
    lam: float = 0.2
    k: float = 3.0
    persistence: int = 3
    forget_us: int | None = None

    def fold(self, rows: np.ndarray, state: tuple) -> tuple[pd.DataFrame, tuple]:
        """Output rows of some rows in time order (``_ROW``) after ``state`` (``_STATE``), and the state after them.

        A score that is missing leaves mean and variance as they are and ends a run.
        """
        if self.forget_us is None:
            return self._fold(rows, state)
        before = np.concatenate([[state[-1] if state[0] else rows["us"][0]], rows["us"][:-1]])
        made = []
        for part in np.split(rows, np.flatnonzero(rows["us"] - before > self.forget_us)):
            if len(part):
                fresh = state[0] and part["us"][0] - state[-1] > self.forget_us
                out, state = self._fold(part, _FRESH if fresh else state)
                made.append(out)
        return pd.concat(made, ignore_index=True), state

    def _fold(self, rows: np.ndarray, state: tuple) -> tuple[pd.DataFrame, tuple]:
        n, seen, mean, var, run, start, _ = state
        s, known = rows["score"], np.isfinite(rows["score"])
        means = smoothed(np.where(known, s, 0.0), known, self.lam, mean if seen else None)
        squares = np.where(known, (s - means) ** 2, 0.0)
        if not seen and known.any():
            squares[np.argmax(known)] = 0.0
        variances = smoothed(squares, known, self.lam, var if seen else None)
        hit, at = known & (s > rows["limit"]), np.arange(len(s))
        last_miss = np.maximum.accumulate(np.where(hit, -1, at))
        runs = np.where(hit, at - last_miss + np.where(last_miss < 0, run, 0), 0)
        begun = rows["us"][np.minimum(last_miss + 1, len(s) - 1)]
        if run:
            begun = np.where(last_miss < 0, start, begun)
        factor = math.sqrt(self.lam / (2.0 - self.lam))
        out = pd.DataFrame({
            "row": n + 1 + at, "us": rows["us"], "score": s, "ewma_mean": means, "ewma_var": variances,
            "dynamic_limit": means + self.k * (np.sqrt(variances) + EPS) * factor, "run": runs,
            "run_start_us": pd.Series(begun, dtype="Int64").where(pd.Series(hit)), "alarm": runs >= max(1, self.persistence)})
        if known.any() or seen:
            seen, mean, var = True, float(means[-1]), float(variances[-1])
        return out, (int(n + len(s)), bool(seen), mean, var, int(runs[-1]), int(begun[-1]), int(rows["us"][-1]))


_ROW = np.dtype([("us", "<i8"), ("score", "<f8"), ("limit", "<f8")])
_STATE = "n bigint, seen boolean, mean double, var double, run bigint, start bigint, last bigint"
_FRESH = (0, False, 0.0, 0.0, 0, 0, 0)
_FOLDED = ("row bigint, us bigint, score double, ewma_mean double, ewma_var double, dynamic_limit double, run bigint, "
           "run_start_us bigint, alarm boolean")


def in_order(rows: np.ndarray) -> np.ndarray:
    """By time; rows of one time by score (missing last), then limit, so that arrival decides nothing."""
    return rows[np.lexsort((rows["limit"], rows["score"], rows["us"]))]


def packed_rows(pdf: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(pdf), dtype=_ROW)
    for name in _ROW.names:
        out[name] = pdf[name].to_numpy(dtype=_ROW[name])
    return out


_PIECE = np.dtype([("first", "<i8"), ("id", "<i8")])


class OrderedAlarm(StatefulProcessor):
    """Rows wait in time order until the watermark has passed them; then they are folded into the series' state.

    Up to ``piece_rows`` waiting rows lie beside the folded state, so that a short series costs one reading and one writing a
    trigger; more wait in pieces, each a stretch of one batch.  A timer stands at a series' earliest waiting row.  When it
    fires, pieces are read by their first times and rows leave as soon as no unread piece can hold an earlier one, so a task
    holds one batch, or the pieces that overlap in time.  The state of a series that stays silent for longer than the rule
    remembers is removed.
    """
    piece_rows = 8192

    def __init__(self, key: str, rule: AlarmRule):
        self.key, self.rule, self.piece_rows = key, rule, self.piece_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{_STATE}, near binary, pieces binary, next_id bigint")
        self.waiting = handle.getMapState("waiting", "id bigint", "body binary")

    def read(self) -> tuple[tuple, np.ndarray, np.ndarray, int]:
        """The folded state, the waiting rows beside it, the pieces and the next one's name."""
        found = self.state.get()
        if found is None:
            return _FRESH, np.empty(0, _ROW), np.empty(0, _PIECE), 0
        return tuple(found[:-3]), np.frombuffer(bytes(found[-3]), _ROW), np.frombuffer(bytes(found[-2]), _PIECE), found[-1]

    def write(self, state: tuple, near: np.ndarray, held: np.ndarray, at: int) -> None:
        if state[0] or len(near) or len(held):
            self.state.update((*state, near.tobytes(), held.tobytes(), at))
        else:
            self.state.clear()

    @staticmethod
    def earliest(near: np.ndarray, held: np.ndarray) -> int | None:
        firsts = [*near["us"][:1], *([held["first"].min()] if len(held) else [])]
        return int(min(firsts)) if firsts else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, near, held, at = self.read()
        before = self.earliest(near, held)
        added = []
        for pdf in rows:
            packed = packed_rows(pdf)
            if len(near) + len(packed) <= self.piece_rows:
                near = in_order(np.concatenate([near, packed]))
                continue
            packed = in_order(packed)
            for start in range(0, len(packed), self.piece_rows):
                self.waiting.updateValue((at,), (packed[start:start + self.piece_rows].tobytes(),))
                added.append((int(packed["us"][start]), at))
                at += 1
        held = np.concatenate([held, np.array(added, _PIECE)])
        first = self.earliest(near, held)
        if first is not None and (before is None or first < before):
            self.handle.registerTimer(first // 1000 + 1)
        self.write(state, near, held, at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state, pool, held, at = self.read()
        first = self.earliest(pool, held)
        if first is None or first > now:
            if state[0] and self.rule.forget_us is not None:
                end = state[-1] + self.rule.forget_us
                if end < now and (first is None or end < first):
                    self.write(_FRESH, pool, held, at)
            return
        held = held[np.argsort(held["first"], kind="stable")]
        due = int(np.searchsorted(held["first"], now, side="right"))
        for i in range(due + 1):
            # Rows before the next piece's first are final; later pieces may start at the same time as the next one does.
            final = int(held["first"][i]) if i < due else now + 1
            n = int(np.searchsorted(pool["us"], final))
            if n and (n >= self.piece_rows or i == due):
                out, state = self.rule.fold(pool[:n], state)
                pool = pool[n:]
                out.insert(0, self.key, key[0])
                yield out
            if i < due:
                ident = (int(held["id"][i]),)
                pool = in_order(np.concatenate([pool, np.frombuffer(bytes(self.waiting.getValue(ident)[0]), _ROW)]))
                self.waiting.removeKey(ident)
        held = held[due:]
        if len(pool) > self.piece_rows:
            self.waiting.updateValue((at,), (pool.tobytes(),))
            held, at = np.concatenate([np.array([(int(pool["us"][0]), at)], _PIECE), held]), at + 1
            pool = pool[:0]
        self.write(state, pool, held, at)
        first = self.earliest(pool, held)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        if self.rule.forget_us is not None:
            self.handle.registerTimer((state[-1] + self.rule.forget_us) // 1000 + 1)

    def close(self) -> None:
        pass


def alarm_input(rows: DataFrame, score: str, limit: str, key: str, ts: str) -> DataFrame:
    """(key, ts, us, score, limit) of the rows that have a time; times as microseconds, which no session zone moves."""
    return rows.where(F.col(ts).isNotNull()).select(
        key, ts, F.unix_micros(F.col(ts)).alias("us"), F.col(score).cast("double").alias("score"),
        F.col(limit).cast("double").alias("limit"))


def alarm_output(folded: DataFrame, score: str, key: str, ts: str) -> DataFrame:
    return folded.select(key, F.timestamp_micros("us").alias(ts), F.col("score").alias(score), "ewma_mean", "ewma_var", "dynamic_limit",
                         "run", F.timestamp_micros("run_start_us").alias("run_start"), "alarm", "row")


def online_alarm(stream: DataFrame, score: str = "score", limit: str = "threshold", lam: float = 0.2, k: float = 3.0,
                 persistence: int = 3, key: str = "series_id", ts: str = "ts", delay: str = "1 hour",
                 forget_seconds: int | None = None) -> DataFrame:
    """Per row: smoothed mean and variance, the moving limit, and an alarm that fires at the ``persistence``-th
    consecutive score above ``limit`` (it cannot look ahead, so it fires persistence - 1 rows after the run began).

    Rows count in the order of their times, whatever trigger brings them: a row may come up to ``delay`` after later ones,
    and comes out once the watermark has passed it.  Later rows than that, and rows without a time, are dropped.  ``row``
    numbers a series' rows.  State per series is seven numbers and the rows that wait; a series begins anew
    after more than ``forget_seconds`` without a row.
    When a stream has ended, ``close_alarm`` gives the rows still waiting.
    """
    rows = alarm_input(stream.withWatermark(ts, delay), score, limit, key, ts)
    kind = stream.schema[key].dataType.simpleString()
    processor = OrderedAlarm(key, AlarmRule(lam, k, persistence, None if forget_seconds is None else forget_seconds * 1_000_000))
    folded = rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {_FOLDED}", "append", "eventTime")
    return alarm_output(folded, score, key, ts)


def close_alarm(rows: DataFrame, emitted: DataFrame, score: str = "score", limit: str = "threshold", lam: float = 0.2,
                k: float = 3.0, persistence: int = 3, key: str = "series_id", ts: str = "ts", forget_seconds: int | None = None) -> DataFrame:
    """The rows that ``online_alarm`` over the same input left waiting when it ended: those later than each series' last one
    that came out, folded on from that row, which holds the whole state."""
    last = emitted.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(
        F.col("row").alias("n"), "ewma_mean", "ewma_var", "run", F.unix_micros("run_start").alias("start"),
        F.unix_micros(F.col(ts)).alias("last")), F.struct(ts, "row")).alias("_last"))
    asked = alarm_input(rows, score, limit, key, ts)
    waiting = (asked.join(last, asked[key].eqNullSafe(F.col("_key")), "left")
                    .where(F.col("_last").isNull() | (F.col("us") > F.col("_last.last")))
                    .select(key, "us", "score", "limit", *[F.col(f"_last.{c}").alias(c) for c in ("n", "ewma_mean", "ewma_var", "run", "start", "last")]))
    kind = rows.schema[key].dataType.simpleString()
    rule = AlarmRule(lam, k, persistence, None if forget_seconds is None else forget_seconds * 1_000_000)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first, state = pdf.iloc[0], _FRESH
        if not pd.isna(first["n"]):
            seen = not pd.isna(first["ewma_mean"])
            state = (int(first["n"]), seen, float(first["ewma_mean"]) if seen else 0.0, float(first["ewma_var"]) if seen else 0.0,
                     int(first["run"]), 0 if pd.isna(first["start"]) else int(first["start"]), int(first["last"]))
        out, _ = rule.fold(in_order(packed_rows(pdf)), state)
        out.insert(0, key, first[key])
        return out
    return alarm_output(waiting.groupBy(key).applyInPandas(fold, f"`{key}` {kind}, {_FOLDED}"), score, key, ts)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table in the shared folder and read it back.

    State lives in a store that keeps several named states and timers; the session's own setting is put back.
    """
    spark = stream.sparkSession
    out, marks = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
                 .option("checkpointLocation", marks).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(out)


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file (or glob) of a folder as a stream, with the schema of the stored files."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
