"""Jobs as a stream with typed state: deliveries move a job, silence sends its continuation again, ended jobs are
forgotten, and what was tried in vain comes out as dead letters.

A job's state is a value of its own; deliveries that failed and come again are a list beside it.  Every job has one
timer: of its silence while it runs, of its memory once it has ended."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators.contracts import TERMINAL
from graphloom.streaming.jobs import ATTEMPTS, NEW, STATE, apply

#: What comes out: `delivery` for each that came in; `resend` and `silent` of timers; `dead` for those in vain.
OUT = "job_id string, place long, what string, outcome string, " + STATE + ", send_stage string, send_cursor string"
_NAMES = [f.strip().split(" ")[0] for f in OUT.split(",")]
HELD = STATE + ", resends int"
TRIED = "place long, stage string, cursor string, fails string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def continuation(state: tuple) -> tuple[str | None, str | None]:
    """The message that moves a job on: its stage, and its cursor where files are fetched."""
    status, stage, cursor, *_ = state
    return (None, None) if status in TERMINAL else (stage, (cursor or "0") if stage == "fetch-content" else None)


class JobProcessor(StatefulProcessor):
    """silence, memory: milliseconds until a running job's continuation is sent again, and until an ended job is
    forgotten; None for never.  clock: `event` or `processing`, the time that counts."""

    def __init__(self, silence: int | None = None, memory: int | None = None, clock: str = "event"):
        self.silence, self.memory, self.clock = silence, memory, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", HELD)
        self.tried = handle.getListState("tried", TRIED)

    def _arm(self, state: tuple, now: int) -> None:
        if self.silence is None and self.memory is None:
            return  # no timers in a query without time
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        wait = self.memory if state[0] in TERMINAL else self.silence
        if wait is not None:
            self.handle.registerTimer(now + wait)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_NAMES).astype({"place": "Int64", "done": "int64", "total": "int64", "moves": "int32"})

    def _dead(self, job: str, state: tuple) -> list[tuple]:
        """What was tried in vain, once the job has failed; forgotten after that."""
        rows = [(job, int(place), "dead", fails, *state, stage, cursor) for place, stage, cursor, fails in self.tried.get()] if self.tried.exists() else []
        self.tried.clear()
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = lambda v: None if pd.isna(v) else v
        state, out = tuple(self.job.get())[:-1] if self.job.exists() else NEW, []
        rows = pd.concat(rows).sort_values("place")
        for place, stage, cursor, total, fails in rows[["place", "stage", "cursor", "total", "fails"]].itertuples(index=False):
            cursor, fails = text(cursor), text(fails)
            state, outcome, send = apply(state, stage, cursor, int(total), fails)
            out.append((key[0], place, "delivery", outcome, *state, *send))
            if outcome in ("retry", "failed"):
                self.tried.appendValue((int(place), stage, cursor, fails))
            if outcome == "failed":
                out += self._dead(key[0], state)
            elif outcome == "moved" and self.tried.exists():
                self.tried.clear()
        self.job.update((*state, 0))
        if self.clock == "event":  # a job's silence begins with its own last delivery, whatever the watermark
            now = int(rows["ts"].max().timestamp() * 1000) if "ts" in rows else 0
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
        self._arm(state, now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *state, resends = tuple(self.job.get())
        state = tuple(state)
        if state[0] in TERMINAL:
            self.job.clear()
            self.tried.clear()
            yield self._frame([])
            return
        if resends < ATTEMPTS:
            out = [(key[0], None, "resend", "resend", *state, *continuation(state))]
            self.job.update((*state, resends + 1))
        else:
            state = ("failed", *state[1:])
            out = [(key[0], None, "silent", "failed", *state, None, None), *self._dead(key[0], state)]
            self.job.update((*state, resends))
        self._arm(state, expiredTimerInfo.getExpiryTimeInMs())
        yield self._frame(out)

    def close(self) -> None:
        pass


@contextmanager
def typed_state(spark: SparkSession):
    """The store that typed state needs, for queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def job_stream(deliveries: DataFrame, silence: int | None = None, memory: int | None = None, clock: str = "event") -> DataFrame:
    """OUT for a stream of deliveries(job_id, place, stage, cursor, total, fails, ...); with silence or memory in event
    time it needs a time `ts` with a watermark.  A job's deliveries of one micro-batch are taken in order of place."""
    timed = silence is not None or memory is not None
    mode = {"event": "eventTime", "processing": "processingTime"}[clock] if timed else "none"
    return deliveries.groupBy("job_id").transformWithStateInPandas(JobProcessor(silence, memory, clock), OUT, "append", mode)


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append what a stream has by now to a folder of Parquet files; started again, it goes on where it ended."""
    with typed_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
