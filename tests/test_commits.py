"""Tables with several writers: races that are made to happen, compare and set, versions and compaction."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from graphloom.sources import commits as C
from graphloom.sources.artifacts import ArtifactTable
from graphloom.sources.shared import shared_folder


def rows_of(spark, *rows, schema="k string, v int, n int"):
    return spark.createDataFrame(list(rows), schema)


def together(monkeypatch, *writers):
    """What writers return that run at once; the first look of each at the table waits for that of all."""
    n = len(writers)
    barrier, seen, plain = threading.Barrier(n), threading.local(), C.CommittedTable.version

    def version(self):
        found = plain(self)
        if not getattr(seen, "once", False):
            seen.once = True
            barrier.wait(60)
        return found

    with monkeypatch.context() as m, ThreadPoolExecutor(n) as pool:
        m.setattr(C.CommittedTable, "version", version)
        return [f.result() for f in [pool.submit(w) for w in writers]]


def test_two_writers_of_one_key(spark, monkeypatch):
    folder = shared_folder(spark)
    put = lambda body: ArtifactTable(spark, folder).put(spark.createDataFrame([(1, "a", body), (2, f"own-{body}", body)], "n int, key string, body string"), "key", "n", "body").collect()
    told = together(monkeypatch, *[lambda b=b: put(b) for b in "xyz"])
    outcomes = {r["body"]: r["outcome"] for w in told for r in w if r["key"] == "a"}
    assert sorted(outcomes.values()) == ["conflict", "conflict", "stored"]
    assert all(r["outcome"] == "stored" for w in told for r in w if r["key"] != "a")
    store = ArtifactTable(spark, folder)
    winner = next(b for b, o in outcomes.items() if o == "stored")
    assert {r["key"]: r["body"] for r in store.read().collect()} == {"a": winner, "own-x": "x", "own-y": "y", "own-z": "z"}
    assert store.version() == 3 and store.history().count() == 4
    assert not [n for n in store.files.names("") if n.startswith("draft")]


def test_one_of_two_updates(spark, monkeypatch):
    jobs = C.CommittedTable(spark, shared_folder(spark), "k string, v int, n int", "k")
    C.insert_absent(jobs, rows_of(spark, ("a", 0, 0), ("b", 5, 0)), "n")
    step = rows_of(spark, ("a", 0, 1), ("b", 0, 1))
    act = lambda by: C.compare_and_set(jobs, step, "n", {"v": F.col("u.v")}, {"v": F.col("row.v") + by}).collect()
    told = [sorted((r["k"], r["outcome"]) for r in w) for w in together(monkeypatch, lambda: act(1), lambda: act(10))]
    assert sorted(told) == [[("a", "stale"), ("b", "stale")], [("a", "updated"), ("b", "stale")]]
    assert {r["k"]: r["v"] for r in jobs.read().collect()} == {"a": 1 if told[0][0][1] == "updated" else 10, "b": 5}


def test_compare_and_set(spark):
    table = C.CommittedTable(spark, shared_folder(spark), "k string, v int, n int", "k")
    assert table.version() == 0 and table.read().count() == 0
    added = C.insert_absent(table, rows_of(spark, ("a", 1, 2), ("a", 2, 1), ("b", None, 1), (None, 3, 1)), "n").collect()
    assert sorted(map(tuple, added), key=repr) == sorted([("a", 2, 1), ("b", None, 1), (None, 3, 1)], key=repr)
    assert C.insert_absent(table, rows_of(spark, ("a", 9, 9), (None, 9, 9), ("c", 4, 1)), "n").collect() == [("c", 4, 1)]
    updates = spark.createDataFrame([("a", 2, 10, 1), ("a", 2, 11, 2), ("b", None, 20, 1), ("c", 5, 30, 1), ("d", None, 40, 1), (None, 3, 50, 1)], "k string, old int, new int, at int")
    told = C.compare_and_set(table, updates, "at", {"v": F.col("u.old")}, {"v": F.col("u.new")}).collect()
    assert {(r["k"], r["at"]): r["outcome"] for r in told} == {("a", 1): "updated", ("a", 2): "stale", ("b", 1): "updated", ("c", 1): "stale", ("d", 1): "missing", (None, 1): "updated"}
    want = {"a": (10, 1), "b": (20, 1), "c": (4, 1), None: (50, 1)}
    current = lambda: {r["k"]: (r["v"], r["n"]) for r in table.read().collect()}
    assert current() == want
    assert {r["k"]: r["v"] for r in table.read(1).collect()} == {"a": 2, "b": None, None: 3}  # an older version
    assert table.compact() and current() == want and len(table.parts(table.version())) == 1
    assert {r["outcome"] for r in C.set_once(table, rows_of(spark, ("a", 0, 1)), "n", "v").collect()} == {"stale"}
    assert {r["outcome"] for r in C.compare_and_set(table, rows_of(spark, ("a", 0, 1)), "n", {}, {"v": F.lit(None)}).collect()} == {"updated"}
    assert {r["outcome"] for r in C.set_once(table, rows_of(spark, ("a", 7, 1), ("a", 8, 2)), "n", "v").collect()} == {"stale", "updated"}
    assert current() == {**want, "a": (7, 1)}


def test_gives_up(spark, monkeypatch):
    table = C.CommittedTable(spark, shared_folder(spark), "k string, v int, n int", "k")
    monkeypatch.setattr(C, "RETRIES", 2)
    monkeypatch.setattr(C.Folder, "create", lambda self, name, text: False)
    with pytest.raises(C.Conflict):
        C.insert_absent(table, rows_of(spark, ("a", 1, 1)), "n")
    assert table.version() == 0 and table.files.names("data") == []
