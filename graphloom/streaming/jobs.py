"""Job deliveries as streams: at-least-once messages, keyed compare-and-set state, usage windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from graphloom.operators.contracts import STAGES
from graphloom.operators.requests import messages

#: Files of eligible entries that a job fetches at once, and deliveries of a message at most.
BATCH, ATTEMPTS = 10, 3


def usage_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests of each user in tumbling windows; works on a stream, with its watermark, and on a table."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "requests")


#: State of a job: where it stands, how much is done, how often it moved and how it ended.
STATE = "status string, stage string, cursor string, done long, total long, moves int"
MOVE = "job_id string, outcome string, " + STATE + ", send_stage string, send_cursor string"


def apply(state: tuple, stage: str, cursor: str | None, total: int, fails: str | None) -> tuple[tuple, str, tuple[str | None, str | None]]:
    """One message on a job's state: the new state, the outcome, and the message to send next.

    A message counts if its stage, and its cursor where it has one, are the job's: compare and set.  Others are
    stale or repeats and change nothing, but the job's own continuation is sent again.  A failure that doesn't
    pass ends the job; one that does sends the message again as it came, and ends the job once it has moved as often
    as there are attempts."""
    status, at, where, done, all_, moves = state
    if status in ("succeeded", "failed", "cancelled"):
        return state, "ended", (None, None)
    if at != stage or (cursor is not None and where != cursor):
        return state, "stale", (at, (where or "0") if at == "fetch-content" else None)
    if fails is not None:
        if fails == "again" and moves < ATTEMPTS:
            return state, "retry", (stage, cursor)
        return ("failed", at, where, done, all_, moves + 1), "failed", (None, None)
    if stage == "inventory":
        return ("running", "fetch-content", "0", 0, total, moves + 1), "moved", ("fetch-content", "0")
    if stage == "fetch-content":
        now = min(all_, done + BATCH)
        ended = now >= all_
        following = ("analyze", None) if ended else ("fetch-content", str(now))
        return ("running", following[0], str(now), now, all_, moves + 1), "moved", following
    return ("succeeded", "complete", where, done, all_, moves + 1), "moved", (None, None)


NEW = ("queued", STAGES[0], None, 0, 0, 0)


def advance(deliveries: DataFrame) -> DataFrame:
    """Stream of deliveries(job_id, stage, cursor, total, fails) to what became of each (MOVE), in the order of each
    job's batches.  The state of a job is a row of its own; no two jobs meet."""

    def step(key, batches: Iterator[pd.DataFrame], held):
        state = tuple(held.get) if held.exists else NEW
        out = []
        for batch in batches:
            for stage, cursor, total, fails in zip(batch["stage"], batch["cursor"], batch["total"], batch["fails"]):
                text = lambda v: None if pd.isna(v) else v
                state, outcome, send = apply(state, stage, text(cursor), int(total), text(fails))
                out.append((key[0], outcome, *state, *send))
        held.update(state)
        names = [f.split(" ")[0] for f in MOVE.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"done": "int64", "total": "int64", "moves": "int32"})

    return deliveries.groupBy("job_id").applyInPandasWithState(step, MOVE, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(deliveries: DataFrame) -> DataFrame:
    """The same of a table with a column place that orders each job's deliveries: job_id and the state it ends in.

    Jobs are dealt out and their deliveries streamed in order, so a job takes one task but no more memory than
    its state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, NEW, []
        names = ["job_id", *[f.split(" ")[0] for f in STATE.split(", ")]]
        for batch in batches:
            for job, stage, cursor, total, fails in zip(batch["job_id"], batch["stage"], batch["cursor"], batch["total"], batch["fails"]):
                if job != now:
                    if now is not None:
                        out.append((now, *state))
                    now, state = job, NEW
                state, _, _ = apply(state, stage, None if pd.isna(cursor) else cursor, int(total), None if pd.isna(fails) else fails)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now is not None:
            out.append((now, *state))
        yield pd.DataFrame(out, columns=names)

    rows = deliveries.select("job_id", "stage", "cursor", "total", "fails", "place").repartition("job_id").sortWithinPartitions("job_id", "place")
    return rows.mapInPandas(run, "job_id string, " + STATE)


def consume(deliveries: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str | None = None):
    """Start a query that hands micro-batches of well-formed, distinct messages to `handle`.  Malformed deliveries are
    acknowledged and dropped, as a queue's consumer does, or kept in the folder dead_letters."""

    def each(batch: DataFrame, n: int) -> None:
        told = messages(batch)
        if dead_letters:
            told.filter("message IS NULL").select("body").write.mode("append").parquet(dead_letters)
        handle(told.filter("message IS NOT NULL").select("message.*").dropDuplicates(), n)

    return deliveries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
