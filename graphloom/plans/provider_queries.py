"""Queries of a provider's stored responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.sources import provider as P
from graphloom.sources import responses as R
from graphloom.sources.fixture import table
from graphloom.sources.shared import shared_folder


def _stored(spark, responses) -> str:
    folder = shared_folder(spark)
    P.store_responses(responses, folder)
    return folder


@query("provider_tree", f"""
SELECT DISTINCT p_brand AS path, '040000' AS mode, 'tree' AS kind, sha1(p_brand) AS sha, NULL::BIGINT AS size FROM part
UNION ALL SELECT DISTINCT p_brand || '/' || p_type, '040000', 'tree', sha1(p_brand || '+' || p_type), NULL FROM part
UNION ALL SELECT p_brand || '/' || p_type || '/' || p_partkey || '.js', {R.MODE},
                 CASE {R.MODE} WHEN '120000' THEN 'symlink' WHEN '160000' THEN 'submodule' ELSE 'blob' END, {R.BLOB}, length(p_name) FROM part""")
def provider_tree(spark, d):
    """A whole tree by the provider's data source; its own listing and some of its subtrees' are cut off."""
    folder = _stored(spark, R.tree_responses(spark, d))
    root = spark.range(1).select(F.sha1(F.lit(R.ROOT))).first()[0]
    return P.provider_tree(spark, folder, root).select("path", "mode", "kind", "sha", "size")


@query("provider_blobs", f"""
SELECT {R.BLOB} AS sha, CASE WHEN p_partkey % 9 IN (0, 1, 2) THEN p_name END AS content, CASE WHEN p_partkey % 9 IN (0, 1, 2) THEN length(p_name) END AS size,
       CASE p_partkey % 9 WHEN 3 THEN 'provider-identity-mismatch' WHEN 4 THEN 'provider-identity-mismatch' WHEN 5 THEN 'invalid-response'
            WHEN 6 THEN 'binary-or-invalid-utf8' WHEN 7 THEN 'missing' WHEN 8 THEN 'invalid-response' END AS reason FROM part""")
def provider_blobs(spark, d):
    """Blobs by their names: what came, and why the others didn't."""
    folder = _stored(spark, R.blob_responses(spark, d))
    blobs = P.provider_blobs(table(spark, d, "part").select(F.expr(R.BLOB).alias("sha")), folder)
    return blobs.select("sha", F.decode("content", "UTF-8").alias("content"), "size", "reason")
