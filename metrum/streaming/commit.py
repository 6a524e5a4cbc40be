"""Fixed-lag decoding of a stream of frames, committed for good frame by frame.

The state of a case holds the frames ahead of the watermark, which are decoded in their order once it has passed them, and the
decoder's own state: scores, back pointers of the frames that aren't decided yet, and a decision that waits at a comma. At
the end of the stream timers decide the frames that are left, and may complete the states that no frame was left for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from metrum.operators.alignment import FRAME_SECONDS, FixedLag, level_scores
from metrum.streaming.tables import ANY_ORDER, SHIFT, case_key, case_of, event_time, run_to_end, table_stream

OUT = "case_id long, frame long, committed int, reason string"
WAITING = "frame long, value double, low double, high double, quiet boolean"
MICROS = round(FRAME_SECONDS * 1e6)


class Commits(StatefulProcessor):
    """waiting: frames ahead of the watermark; undecided: numbers of the decoded frames without a decision; decoder: its state,
    the time its timer is set to (0: none), and whether the end has come."""

    def __init__(self, stay: list[float], lag: int, pause: list[bool], complete: bool, go: list[float] | None = None):
        self.stay, self.lag, self.pause, self.complete, self.go = stay, lag, pause, complete, go

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.undecided = handle.getListState("undecided", "frame long")
        self.decoder = handle.getValueState("decoder", "kept string, timer long")

    def _go_on(self, case: int | None, frames: list[tuple], watermark: int, fired: bool) -> pd.DataFrame:
        kept, timer = self.decoder.get() if self.decoder.exists() else (None, 0)
        machine = FixedLag(np.array(self.stay), self.lag, np.array(self.pause), json.loads(kept) if kept else None, self.go)
        numbers = [int(r[0]) for r in self.undecided.get()] if self.undecided.exists() else []
        frames.sort(key=lambda f: f[0])
        rows = []
        now = [f for f in frames if f[0] * MICROS + SHIFT <= watermark * 1000]
        value, low, high = (np.array([f[k] for f in now], float) for k in (1, 2, 3))
        for (frame, *_, quiet), scores in zip(now, level_scores(value, low, high, len(self.stay)), strict=True):
            numbers.append(frame)
            done = machine.push(scores, quiet)
            rows += [(case, n, s, "fixed_lag") for n, s in zip(numbers, done, strict=False)]
            numbers = numbers[len(done) :]
        left = frames[len(now) :]
        ended = watermark * 1000 >= _LAST
        if ended:
            done, tail = machine.finish(self.complete)
            last = numbers[-1] if numbers else max((r[1] for r in rows), default=-1)
            rows += [(case, n, s, "end_of_stream") for n, s in zip(numbers, done, strict=True)]
            rows += [(case, last + k + 1, s, "end_of_stream_completion") for k, s in enumerate(tail)]
            for state in (self.waiting, self.undecided, self.decoder):
                state.clear()
        else:
            due = -(-(left[0][0] * MICROS + SHIFT) // 1000) if left else _LAST // 1000
            if fired or timer != due:
                if timer and not fired:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.decoder.update((json.dumps(machine.kept), due))
            for state, values in ((self.waiting, left), (self.undecided, [(n,) for n in numbers])):
                state.put(values) if values else state.clear()
        return pd.DataFrame(rows, columns=["case_id", "frame", "committed", "reason"]).astype({"case_id": "Int64"})

    def _waiting(self) -> list[tuple]:
        return [(int(f), float(v), float(lo), float(hi), bool(q)) for f, v, lo, hi, q in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = self._waiting()
        for b in rows:
            b = b[~b["ended"]]
            frames += zip(b["frame"].tolist(), b["value"].tolist(), b["low"].tolist(), b["high"].tolist(), b["quiet"].tolist(), strict=True)
        if frames:
            yield self._go_on(case_of(key[0]), frames, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._go_on(case_of(key[0]), self._waiting(), timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


#: The watermark is beyond this only at the end of the stream: half the way from today's data to the mark of the end.
_LAST = pd.Timestamp("2150-01-01").value // 1000


def commit(frames: DataFrame, stay: list[float], lag: int, pause: list[bool] | None = None, complete: bool = False, go: list[float] | None = None) -> DataFrame:
    """case_id, frame, committed, reason from a stream of frames (key, see case_key, frame, value, low, high: the range that the case's
    levels are spaced over, quiet, ended) with a watermark on their time (see frame_time)."""
    return frames.groupBy("key").transformWithStateInPandas(Commits(stay, lag, pause or [False] * len(stay), complete, go), OUT, "Append", "EventTime")


def frame_time(frame: Column) -> Column:
    """The time of a frame's number."""
    return event_time(frame * MICROS)


def commits_of_events(spark: SparkSession, path: str, stay: list[float], lag: int, pause: list[bool] | None = None, quiet_below: float | None = None, complete: bool = False, files: int = 1000, lateness: str = ANY_ORDER, folder: str | None = None, end: bool = True, known_from: str | None = None, go: list[float] | None = None) -> DataFrame:
    """The stream over an events table (see table_stream), event numbers as frames, decided to the end. The range of a case's
    values is known beforehand, from that table or the one named by known_from; a value under quiet_below is quiet. lateness is in time of frames, 10 ms each."""
    case, frame = case_key(F.col("user_id")), F.col("event_id").alias("frame")
    known = spark.read.parquet(known_from or path).groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumnRenamed("user_id", "_case")
    rows = table_stream(spark, path, files).join(known, F.col("user_id").eqNullSafe(F.col("_case")))
    quiet = F.lit(False) if quiet_below is None else F.col("value") < quiet_below
    rows = rows.select(case, frame, "value", "low", "high", quiet.alias("quiet"), frame_time(F.col("event_id")).alias("at"))
    return run_to_end(spark, rows, lambda d: commit(d, stay, lag, pause, complete, go), folder, lateness, end)
