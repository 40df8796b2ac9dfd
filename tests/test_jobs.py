"""Job state as a stream and as a replay, and what stores and folders hold."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import contracts as C
from graphloom.sources import artifacts as A
from graphloom.sources import local as L
from graphloom.sources.shared import shared_folder
from graphloom.streaming import jobs as J

DELIVERY = "job_id string, stage string, cursor string, total int, fails string, place int"


def test_moves_of_a_job():
    state, sent = J.NEW, []
    for stage, cursor in (("inventory", None), ("inventory", None), ("fetch-content", "0"), ("fetch-content", "0"), ("fetch-content", "10"), ("analyze", None), ("analyze", None)):
        state, outcome, send = J.apply(state, stage, cursor, 11, None)
        sent.append((outcome, send))
    assert state == ("succeeded", "complete", "11", 11, 11, 4)
    assert sent == [("moved", ("fetch-content", "0")), ("stale", ("fetch-content", "0")), ("moved", ("fetch-content", "10")), ("stale", ("fetch-content", "10")), ("moved", ("analyze", None)), ("moved", (None, None)), ("ended", (None, None))]
    assert J.apply(J.NEW, "inventory", None, 5, "again")[:2] == (J.NEW, "retry")
    late = ("running", "fetch-content", "10", 10, 50, 3)
    assert J.apply(late, "fetch-content", "10", 5, "again")[0][0] == "failed" and J.apply(late, "fetch-content", None, 5, "bad")[1] == "failed"


def deliveries(seed=4):
    rnd = random.Random(seed)
    out = []
    for k in range(200):
        job = f"job_{rnd.randint(0, 5)}"
        out.append((job, rnd.choice(["inventory", "fetch-content", "fetch-content", "analyze"]), rnd.choice([None, None, "0", "10"]), 25, rnd.choice([None] * 9 + ["again"]), k))
    return out


def test_replay_and_stream_end_alike(spark, tmp_path):
    rows = deliveries()
    want = {}
    for job, stage, cursor, total, fails, _ in rows:
        want[job] = J.apply(want.get(job, J.NEW), stage, cursor, total, fails)[0]
    table = spark.createDataFrame(rows, DELIVERY)
    assert {r["job_id"]: tuple(r)[1:] for r in J.replay(table.repartition(3)).collect()} == want
    for part in range(2):  # a restart between two files: state goes on
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], DELIVERY).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(DELIVERY).json(str(tmp_path / "in"))
        q = J.advance(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    moved = spark.read.parquet(str(tmp_path / "out"))
    assert moved.count() == 200
    last = moved.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "cursor", "done", "total", "moves"), F.struct("moves", "done")).alias("s")).select("job_id", "s.*")
    assert {r["job_id"]: r["moves"] for r in last.collect()} == {k: v[5] for k, v in want.items()}


def test_consumer_drops_and_keeps(spark, tmp_path):
    good = '{"schemaVersion":"1.0","jobId":"j","expectedStage":"analyze"}'
    bodies = [good, good, "no", '{"schemaVersion":"1.0","jobId":"j","expectedStage":"analyze","more":1}', '{"schemaVersion":"1.0","jobId":" j","expectedStage":"analyze"}', '[1]']
    spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("body string").parquet(str(tmp_path / "in"))
    J.consume(stream, lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "c"), str(tmp_path / "dead")).awaitTermination(120)
    assert seen == [("j", "analyze", None)] and spark.read.parquet(str(tmp_path / "dead")).count() == 4


def test_artifacts(spark):
    store = A.ArtifactTable(spark, shared_folder(spark))
    put = lambda *rows: {r["n"]: r["outcome"] for r in store.put(spark.createDataFrame(rows, "n int, key string, body string"), "key", "n", "body").collect()}
    assert put((1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", None)) == {1: "stored", 2: "same", 3: "conflict", 4: "stored"}
    assert put((5, "a", "x"), (6, "b", "z"), (7, "c", "z")) == {5: "same", 6: "conflict", 7: "stored"}
    got = {r["key"]: (r["body"], r["intact"]) for r in store.get(spark.createDataFrame([("a",), ("c",), ("none",)], "key string")).collect()}
    assert got == {"a": ("x", True), "c": ("z", True)}
    with pytest.raises(ValueError):
        A.artifact_key("other", F.lit("x"))


def test_folder(spark, tmp_path):
    import hashlib

    for name, body in (("a.ts", b"let a"), ("sub/b.md", b"# b"), ("sub/c.bin", b"\0\1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: (r["size"], bytes(r["content"]), r["sha"]) for r in L.folder_tree(spark, str(tmp_path)).collect()}
    assert got == {n: (len(b), b, hashlib.sha1(b"blob %d\0" % len(b) + b).hexdigest()) for n, b in (("a.ts", b"let a"), ("sub/b.md", b"# b"), ("sub/c.bin", b"\0\1"))}


def test_addresses_and_refs(spark):
    urls = {"https://github.com/Acme/Tool": ("Acme", "Tool"), "HTTPS://GitHub.com/acme/tool.git": ("acme", "tool"), "https://github.com/acme/tool.git.git": ("acme", "tool.git"), "https://github.com/acme/.tool": None, "https://github.com/acme/tool/": None, "https://github.com:443/a/b": None, "": None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("r", C.repository_of(F.col("u"))).collect()
    assert {r["u"]: r["r"] and tuple(r["r"]) for r in rows} == urls
    refs = {"main": True, "a/b.c": True, "": False, "a..b": False, "a\\b": False, "[x": False, "a\x01": False, "x" * 1025: False}
    assert {r["u"]: r["ok"] for r in spark.createDataFrame([(u,) for u in refs], "u string").withColumn("ok", C.valid_ref(F.col("u"))).collect()} == refs
