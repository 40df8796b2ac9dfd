"""A content-addressed store as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.export import put_outcomes
from graphloom.sources.commits import CommittedTable

#: Kinds of artifacts.
KINDS = ("manifest", "blob", "result")
ARTIFACT = "key string, hash string, body string"


def artifact_key(kind: str, identity: Column) -> Column:
    """Key of an artifact; null where the identity is empty, absolute or climbs."""
    if kind not in KINDS:
        raise ValueError(f"no kind of artifact: {kind}")
    bad = identity.isNull() | (identity == "") | identity.startswith("/") | identity.contains("..")
    return F.when(~bad, F.concat(F.lit(f"{kind}/"), identity))


def checkpoint_key(snapshot: Column, cursor: Column) -> Column:
    """Key of the manifest that a cursor of a snapshot's job names."""
    start = cursor.isNull() | (cursor == "0")
    return artifact_key("manifest", F.concat(snapshot, F.when(start, "/inventory.json").otherwise(F.concat(F.lit("/progress-"), cursor, F.lit(".json")))))


def hash_of(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256)


class ArtifactTable(CommittedTable):
    """Artifacts in a folder that a cluster shares; any number of writers at once."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ARTIFACT, "key")

    def put(self, writes: DataFrame, key: str, order: str, body: str) -> DataFrame:
        """Store writes and return their outcomes: a key that is there with equal content, or that is written
        twice with it, is the `same`, with other content a `conflict`; what was stored is read back and
        compared, and is an error if it differs."""
        told = put_outcomes(writes, key, order, body).withColumn("__new", hash_of(F.col(body)))

        def build(current: DataFrame):
            there = current.select(F.col("key").alias("__key"), F.col("hash").alias("__there"), F.lit(True).alias("__have"))
            both = told.join(there, F.col(key).eqNullSafe(F.col("__key")), "left")
            outcome = F.when(F.col("__have").isNull(), F.col("outcome")).when(F.col("__there") == F.col("__new"), "same").otherwise("conflict")
            both = both.withColumn("outcome", outcome)
            stored = both.filter("outcome = 'stored'").select(F.col(key).alias("key"), F.col("__new").alias("hash"), F.col(body).alias("body"))
            return stored, both.select(*writes.columns, "outcome")

        outcomes = self.change(build)
        if not self.get(outcomes.filter("outcome = 'stored'").select(F.col(key).alias("key"))).filter("NOT intact").isEmpty():
            raise RuntimeError("an artifact reads back otherwise than it was written")
        return outcomes

    def get(self, keys: DataFrame) -> DataFrame:
        """key, hash, body, intact of keys(key) that are there."""
        return self.read().join(keys.distinct(), "key", "left_semi").withColumn("intact", hash_of(F.col("body")) == F.col("hash"))


def results(index: DataFrame, artifacts: DataFrame, schema: str) -> DataFrame:
    """job_id, state, result for index(job_id, status, result_key, result_hash): the parsed result of each job that
    succeeded with a result that is there, intact and its own; state says what else is the matter."""
    a = artifacts.select(F.col("key").alias("result_key"), F.col("body"), hash_of(F.col("body")).alias("__hash"))
    r = index.join(a, "result_key", "left").withColumn("parsed", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    state = (
        F.when(F.col("status") != "succeeded", "not_ready")
        .when(F.col("result_key").isNull() | F.col("result_hash").isNull(), "unavailable")
        .when(F.col("body").isNull(), "missing")
        .when(F.col("__hash") != F.col("result_hash"), "damaged")
        .when(F.col("parsed").isNull() | F.col("parsed.jobId").isNull(), "malformed")
        .when(F.col("parsed.jobId") != F.col("job_id"), "other_job")
        .otherwise("ok")
    )
    return r.select("job_id", state.alias("state"), F.when(state == "ok", F.col("parsed")).alias("result"))
