"""The typed-state stream of jobs: restarts, timers in event time, forgetting and dead letters."""

import datetime
from collections import Counter


from graphloom.streaming import jobs as J
from graphloom.streaming import stateful as ST

DELIVERY = "job_id string, place long, stage string, cursor string, total int, fails string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def run(spark, folder, batches, **options):
    """Each batch of (seconds, job, place, stage, cursor, total, fails) in a run of its own, and all that came out."""
    out = []
    for rows in batches:
        rows = [(job, place, stage, cursor, total, fails, START + datetime.timedelta(seconds=s)) for s, job, place, stage, cursor, total, fails in rows]
        spark.createDataFrame(rows, DELIVERY).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(DELIVERY).parquet(f"{folder}/in").withWatermark("ts", "0 seconds")
        ST.run_to_end(ST.job_stream(stream, **options), f"{folder}/out", f"{folder}/c")
        out.append(list((Counter(map(tuple, spark.read.parquet(f"{folder}/out").collect())) - Counter(r for got in out for r in got)).elements()))
    return out


def test_stream_equals_fold(spark, tmp_path):
    rows = [("a", "inventory", None, None), ("a", "inventory", None, None), ("a", "fetch-content", "0", "again"), ("a", "fetch-content", "0", None), ("b", "analyze", None, None), ("a", "fetch-content", "10", None), ("a", "analyze", None, "bad"), ("a", "analyze", None, None)]
    batches = [[(k, job, k, stage, cursor, 11, fails) for k, (job, stage, cursor, fails) in enumerate(rows) if k // 3 == part] for part in range(3)]
    state, want = {}, set()
    for k, (job, stage, cursor, fails) in enumerate(rows):
        state[job], outcome, send = J.apply(state.get(job, J.NEW), stage, cursor, 11, fails)
        want.add((job, k, "delivery", outcome, *state[job], *send))
    got = set().union(*run(spark, str(tmp_path), batches))
    assert {r for r in got if r[2] == "delivery"} == want
    assert sum(r[3] == "stale" and r[-2] is not None for r in got) == 2  # stale deliveries send the continuation
    dead = {r for r in got if r[2] == "dead"}
    assert {(r[0], r[1], r[3]) for r in dead} == {("a", 6, "bad")}  # what was tried again and moved on isn't dead


def test_timers(spark, tmp_path):
    clock = lambda s, place: (s, "clock", place, "analyze", None, 5, None)
    batches = [
        [(0, "a", 1, "inventory", None, 25, None), (0, "b", 2, "inventory", None, 25, None), (0, "b", 3, "fetch-content", "0", 25, "bad"), clock(0, 4)],
        [clock(50, 5)],  # the watermark passes to 50 s after this
        [clock(120, 6), (110, "a", 7, "fetch-content", "0", 25, "again")],
        *[[clock(300 * k, 10 + k)] for k in range(1, 8)],
    ]
    out = run(spark, str(tmp_path), batches, silence=100_000, memory=400_000)
    resends = [[(r[-2], r[-1]) for r in got if r[0] == "a" and r[2] == "resend"] for got in out]
    assert resends[:3] == [[], [], []] and sum(resends, []) == J.ATTEMPTS * [("fetch-content", "0")]
    ended = [r for got in out for r in got if r[0] == "a" and r[2] in ("silent", "dead")]
    assert sorted((r[2], r[3], r[4]) for r in ended) == [("dead", "again", "failed"), ("silent", "failed", "failed")]
    assert sorted((r[2], r[3]) for r in out[0] if r[0] == "b" and r[1] == 3) == [("dead", "bad"), ("delivery", "failed")]
    # long after its end job b is forgotten: a delivery of the same name starts a new job
    again = run(spark, str(tmp_path), [[(3000, "b", 99, "inventory", None, 7, None)]], silence=100_000, memory=400_000)[0]
    assert [(r[3], r[4], r[5]) for r in again if r[1] == 99] == [("moved", "running", "fetch-content")]


def test_continuation():
    assert ST.continuation(J.NEW) == ("inventory", None)
    assert ST.continuation(("running", "fetch-content", None, 0, 5, 1)) == ("fetch-content", "0")
    assert ST.continuation(("running", "analyze", "5", 5, 5, 2)) == ("analyze", None)
    assert ST.continuation(("failed", "analyze", "5", 5, 5, 2)) == (None, None)
