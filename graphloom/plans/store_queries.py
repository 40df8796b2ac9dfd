"""Queries of tables that several writers change, some of them at once."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.sources import commits as C
from graphloom.sources.artifacts import ArtifactTable
from graphloom.sources.fixture import table
from graphloom.sources.shared import shared_folder


def _at_once(*writers):
    """What writers return that run at the same time."""
    with ThreadPoolExecutor(len(writers)) as pool:
        return [f.result() for f in [pool.submit(w) for w in writers]]


@query("insert_if_absent", """
SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id""")
def insert_if_absent(spark, d):
    """Rows that a table of customers lacked, added once for each key."""
    kept = C.CommittedTable(spark, shared_folder(spark), "user_id long, event_id long", "user_id")
    have = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"))
    C.insert_absent(kept, have, "event_id")
    return C.insert_absent(kept, table(spark, d, "events").select("user_id", "event_id"), "event_id")


@query("manifest_write_once", """
SELECT user_id AS snapshot, min(event_id) AS event_id, arg_min(event_type, event_id) AS manifest_key, count(*) - 1 AS refused FROM events GROUP BY 1""")
def manifest_write_once(spark, d):
    """The first finalisation of a snapshot stands; later ones, in the same batch or another, are refused."""
    e = table(spark, d, "events").select(F.col("user_id").alias("snapshot"), "event_id", F.col("event_type").alias("manifest_key"))
    kept = C.CommittedTable(spark, shared_folder(spark), "snapshot long, manifest_key string", "snapshot")
    C.insert_absent(kept, e.select("snapshot", F.lit(None).cast("string").alias("manifest_key")).distinct(), "snapshot")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    told = [C.set_once(kept, part, "event_id", "manifest_key") for part in (e.filter(F.col("event_id") <= middle), e.filter(F.col("event_id") > middle))]
    told = told[0].unionByName(told[1]).groupBy("snapshot").agg(F.min(F.when(F.col("outcome") == "updated", F.col("event_id"))).alias("event_id"), F.count_if(F.col("outcome") == "stale").alias("refused"))
    return told.join(kept.read(), "snapshot")


@query("concurrent_puts", """
SELECT 'blob/' || p_partkey AS key, 1 AS stored, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS same, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS conflicts, true AS intact FROM part""")
def concurrent_puts(spark, d):
    """Two writers put every key at once, some with other content: one stores it, whichever is first, and the other is
    told so."""
    p, folder = table(spark, d, "part"), shared_folder(spark)
    key = F.concat(F.lit("blob/"), F.col("p_partkey").cast("string"))
    one = p.select("p_partkey", key.alias("key"), F.col("p_name").alias("body"))
    other = p.select("p_partkey", key.alias("key"), F.when(F.col("p_size") % 3 == 0, F.reverse("p_name")).otherwise(F.col("p_name")).alias("body"))
    told = _at_once(*[lambda w=w: ArtifactTable(spark, folder).put(w, "key", "p_partkey", "body") for w in (one, other)])
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    outcomes = told[0].unionByName(told[1]).groupBy("key").agg(n("stored").alias("stored"), n("same").alias("same"), n("conflict").alias("conflicts"))
    return outcomes.join(ArtifactTable(spark, folder).get(one.select("key")).select("key", "intact"), "key")


@query("concurrent_updates", """
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'queued' ELSE 'running' END AS status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '0' END AS cursor,
       CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS updated, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS stale FROM customer
UNION ALL SELECT -1, NULL, NULL, 0, 0""")
def concurrent_updates(spark, d):
    """Two workers take the same step of every job at once: compare and set lets one of them.  A fifth of the jobs have
    a cursor that neither expects, and one update names no job."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    jobs = C.CommittedTable(spark, shared_folder(spark), "job_id long, status string, stage string, cursor string", "job_id")
    new = F.when(F.col("job_id") % 5 == 0, "7")
    C.insert_absent(jobs, c.select("job_id", F.lit("queued").alias("status"), F.lit("inventory").alias("stage"), new.alias("cursor")), "job_id")
    step = c.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("job_id"))).withColumn("at", F.lit(1))
    expected = {"status": F.lit("queued"), "stage": F.lit("inventory"), "cursor": F.lit(None)}
    changes = {"status": F.lit("running"), "stage": F.lit("fetch-content"), "cursor": F.lit("0")}
    told = _at_once(*[lambda: C.compare_and_set(jobs, step, "at", expected, changes) for _ in range(2)])
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    counts = told[0].unionByName(told[1]).groupBy("job_id").agg(n("updated").alias("updated"), n("stale").alias("stale"))
    return counts.join(jobs.read(), "job_id", "left").select("job_id", "status", F.when(F.col("status") == "running", F.col("cursor")).alias("cursor"), "updated", "stale")
