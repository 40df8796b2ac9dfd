"""Queries of the rules that records must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import contracts as C
from graphloom.plans.registry import query
from graphloom.sources.fixture import SQL as FX
from graphloom.sources.fixture import edges, nodes
from graphloom.sources.records import ENTRIES, INPUTS, JOBS, LINES, RESULTS


def rules_sql(rows: str, keys: str, rules: dict[str, str]) -> str:
    """A row for each rule whose condition of failing holds."""
    return " UNION ALL ".join(f"SELECT {keys}, '{name}' AS rule FROM ({rows}) WHERE {fails}" for name, fails in rules.items())


TRIMMED = "({c} IS NULL OR {c} = '' OR regexp_matches({c}, '^\\s|\\s$'))"
SAFE = "(path = '' OR regexp_matches(path, '^/|/$|\\\\|[\\x00-\\x1F\\x7F]|^\\s|\\s$') OR len(list_intersect(string_split(path, '/'), ['', '.', '..'])) > 0)"
ISO = "regexp_matches({c}, '^\\d{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])T(([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d\\.\\d{{3}}|24:00:00\\.000)Z$')"


@query("manifest_violations", f"SELECT rule, count(*) AS n, count(DISTINCT snapshot) AS snapshots FROM (" + rules_sql(ENTRIES.sql, "snapshot", {
    "kind": "kind NOT IN ('blob', 'symlink', 'submodule')",
    "mode": "NOT ((kind = 'blob' AND mode IN ('100644', '100755')) OR (kind = 'symlink' AND mode = '120000') OR (kind = 'submodule' AND mode = '160000'))",
    "path": SAFE,
    "sha": "NOT regexp_matches(sha, '^[0-9a-f]{40}$')",
    "size": "size < 0",
    "eligible-kind": "kind <> 'blob' AND eligible",
    "reason-of-eligible": "eligible AND reason IS NOT NULL",
    "content-hash": "content_hash IS NOT NULL AND NOT regexp_matches(content_hash, '^[0-9a-f]{64}$')",
    "content-of-ineligible": "NOT eligible AND (content_key IS NOT NULL OR content_hash IS NOT NULL)",
}) + ") GROUP BY rule")
def manifest_violations(spark, d):
    out = C.broken(ENTRIES.read(spark, d), ["snapshot"], C.entry_rules())
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snapshot").alias("snapshots"))


@query("snapshot_violations", f"""WITH e AS ({ENTRIES.sql}), c AS (SELECT s_suppkey AS snapshot, discovered, analyzed, skipped, bytes, analyzed_bytes FROM ({RESULTS.sql})),
p AS (SELECT snapshot, count(*) AS entries, count(*) FILTER (eligible) AS eligible, bool_or(eligible AND size > 120000) AS large, count(DISTINCT path) < count(*) AS again FROM e GROUP BY 1), r AS (SELECT * FROM p LEFT JOIN c USING (snapshot))
""" + rules_sql("SELECT * FROM r", "snapshot", {
    "entries-limit": "entries > 10000", "duplicate-paths": "again", "eligible-limit": "eligible > 100", "file-limit": "large", "coverage-files": "analyzed + skipped > discovered", "coverage-bytes": "analyzed_bytes > bytes",
    "discovered-below-entries": "discovered < entries", "analyzed-above-eligible": "analyzed > eligible",
}))
def snapshot_violations(spark, d):
    coverage = RESULTS.read(spark, d).select(F.col("s_suppkey").alias("snapshot"), "discovered", "analyzed", "skipped", "bytes", "analyzed_bytes")
    return C.snapshot_violations(ENTRIES.read(spark, d), coverage)


@query("snapshot_equality", f"SELECT s_suppkey, s_suppkey % 3 <> 1 AND s_suppkey % 4 <> 2 AND s_suppkey % 5 <> 3 AS same FROM ({RESULTS.sql})")
def snapshot_equality(spark, d):
    """A snapshot and another reading of it: of another commit or tree in some rows, unknown in others."""
    r = RESULTS.read(spark, d)
    k = F.col("s_suppkey")
    other = r.withColumn("commit_sha", F.when(k % 3 == 1, F.sha1(F.lit("x"))).otherwise(F.col("commit_sha"))).withColumn("tree_sha", F.when(k % 4 != 2, F.col("tree_sha"))).withColumn("requested_ref", F.lit("other"))
    other = other.withColumn("provider", F.when(k % 5 == 3, F.lit("none")).otherwise(F.col("provider")))
    mine = r.withColumn("tree_sha", F.when(k % 4 != 2, F.col("tree_sha")).otherwise(F.lit("seen")))
    return C.same_snapshots(mine, other, "s_suppkey")


@query("ref_check", f"SELECT event_id, NOT (ref = '' OR starts_with(ref, '/') OR ends_with(ref, '/') OR contains(ref, '..') OR contains(ref, '//') OR contains(ref, '@{{') OR regexp_matches(ref, '[ ~^:?*\\\\\\[\\]]')) AS valid FROM ({INPUTS.sql})")
def ref_check(spark, d):
    return INPUTS.read(spark, d).select("event_id", C.valid_ref(F.col("ref")).alias("valid"))


ADDRESS = "regexp_extract(url, '^https://github\\.com/([A-Za-z0-9](?:[A-Za-z0-9._-]{0,98}[A-Za-z0-9_-])?)/([A-Za-z0-9](?:[A-Za-z0-9._-]{0,98}[A-Za-z0-9_-])?)$', "


@query("repository_address", f"""WITH u AS (SELECT event_id, rid, regexp_replace(url, '\\.git$', '') AS url FROM ({INPUTS.sql})), p AS (SELECT event_id, rid, {ADDRESS}1) AS owner, {ADDRESS}2) AS repo FROM u)
SELECT event_id, nullif(owner, '') AS owner, nullif(repo, '') AS repo, CASE WHEN owner <> '' THEN 'github:' || lower(owner) || '/' || lower(repo) END AS id, regexp_matches(rid, '^github:[a-z0-9][a-z0-9._-]*/[a-z0-9]([a-z0-9._-]*[a-z0-9_-])?$') AS valid_id, 'https://github.com/' || split_part(rid, ':', 2) AS url FROM p""")
def repository_address(spark, d):
    """Owner, name and id of addresses, and the address of ids."""
    r = INPUTS.read(spark, d).withColumn("of", C.repository_of(F.col("url")))
    return r.select("event_id", "of.owner", "of.repo", C.repository_id(F.col("of.owner"), F.col("of.repo")).alias("id"), F.col("rid").rlike(C.REPOSITORY_ID).alias("valid_id"), C.canonical_url(F.col("rid")).alias("url"))


@query("iso_timestamp_check", f"SELECT event_id, {ISO.format(c='stamp')} AS valid, CASE WHEN {ISO.format(c='stamp')} THEN stamp[1:10] END AS day FROM ({INPUTS.sql})")
def iso_timestamp_check(spark, d):
    """Which timestamps are of the one form that records use, and the day of those."""
    ok = C.valid_timestamp(F.col("stamp"))
    return INPUTS.read(spark, d).select("event_id", ok.alias("valid"), F.when(ok, F.substring("stamp", 1, 10)).alias("day"))


@query("job_state_violations", rules_sql(JOBS.sql, "event_id", {
    "status": "status = 'paused'",
    "stage": "stage = 'rest'",
    "units": "done < 0 OR total < 0",
    "done-above-total": "done > total",
    "error-code": "error_code = 'odd'",
    "error-text": "error_code IS NOT NULL AND " + TRIMMED.format(c="error_text"),
    "error-retry": "error_code IS NOT NULL AND retry IS NULL",
    "failed-without-error": "status = 'failed' AND error_code IS NULL",
    "error-without-failure": "status <> 'failed' AND error_code IS NOT NULL",
    "succeeded-before-complete": "status = 'succeeded' AND stage <> 'complete'",
    "terminal-without-end": "status IN ('succeeded', 'failed', 'cancelled') AND completed IS NULL",
    "created": f"NOT {ISO.format(c='created')}",
}))
def job_state_violations(spark, d):
    return C.broken(JOBS.read(spark, d), ["event_id"], C.job_rules())


@query("job_row_checks", rules_sql(JOBS.sql, "event_id", {
    "status": "status NOT IN ('queued', 'running', 'succeeded', 'failed', 'cancelled')",
    "stage": "stage NOT IN ('inventory', 'fetch-content', 'analyze', 'complete')",
    "units": "done < 0 OR total < 0 OR done > total",
    "error-fields": "(error_code IS NULL)::INT + (error_text IS NULL)::INT + (retry IS NULL)::INT IN (1, 2)",
    "succeeded-complete": "status = 'succeeded' AND stage <> 'complete'",
}))
def job_row_checks(spark, d):
    return C.broken(JOBS.read(spark, d), ["event_id"], C.stored_job_rules())


@query("job_status_projection", f"""SELECT event_id, job_id AS analysis_id, status, stage, done, total, CASE WHEN error_code IS NOT NULL AND error_text IS NOT NULL AND retry IS NOT NULL THEN error_code || ': ' || error_text || CASE WHEN retry THEN ' (again)' ELSE '' END END AS error FROM ({JOBS.sql})""")
def job_status_projection(spark, d):
    out = C.status_projection(JOBS.read(spark, d))
    return out.withColumn("error", F.concat("error.code", F.lit(": "), "error.message", F.when(F.col("error.retryable"), " (again)").otherwise("")))


@query("failure_mapping", f"""SELECT event_id, CASE code WHEN 'not_found' THEN 'repository_not_found' WHEN 'rate_limited' THEN 'rate_limited' WHEN 'invalid_response' THEN 'invalid_provider_response' WHEN 'invalid_path' THEN 'invalid_provider_response' ELSE CASE WHEN code IS NULL THEN 'analysis_failed' END END AS code,
CASE WHEN code IN ('aborted', 'network', 'server_error') THEN NULL ELSE false END AS retry, code IN ('aborted', 'network', 'server_error') AND code IS NOT NULL AS again FROM ({INPUTS.sql})""")
def failure_mapping(spark, d):
    """What failures make of jobs; those that pass are delivered again instead."""
    f = INPUTS.read(spark, d).withColumn("f", C.failure(F.col("code")))
    return f.select("event_id", "f.code", "f.retry", F.col("f").isNull().alias("again"))


@query("retry_after", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 100)::DOUBLE WHEN 1 THEN greatest(ceil(epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(date_trunc('second', ts))), 0) END AS seconds FROM events""")
def retry_after(spark, d):
    """Seconds to wait: a number, a date, something else or nothing."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 4
    value = F.when(k == 0, (F.col("event_id") % 100).cast("string")).when(k == 1, F.lit("Mon, 15 Jan 2024 12:00:00 GMT")).when(k == 2, F.lit("soon"))
    return e.select("event_id", C.retry_after(value, F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("seconds"))


@query("import_rule_violations", "SELECT rule, count(*) AS n FROM (" + rules_sql(LINES.sql, "edge_id", {
    "mode": "mode = 'eager'",
    "specifier": "specifier = '' OR regexp_matches(specifier, '^\\s|\\s$|[\\x00-\\x1F\\x7F]')",
    "type-only": "mode = 'type' AND NOT type_only",
    "ambiguous-candidates": "resolution = 'ambiguous' AND NOT contains(options, ',')",
    "unresolved-candidates": "resolution = 'unresolved' AND options <> ''",
}) + ") GROUP BY rule")
def import_rule_violations(spark, d):
    candidates = F.filter(F.split("options", ","), lambda x: x != "")
    out = C.broken(LINES.read(spark, d).withColumn("candidates", candidates), ["edge_id"], C.import_rules())
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("edge_rule_violations", "SELECT rule, count(*) AS n FROM (" + rules_sql(LINES.sql, "edge_id", {
    "kind": "kind = 'exports'",
    "provenance": "provenance = 'GUESSED'",
    "confidence-range": "confidence > 1 OR confidence < 0",
    "metadata-missing": "kind IN ('imports', 'requires') AND resolution IS NULL",
    "metadata-forbidden": "kind NOT IN ('imports', 'requires') AND resolution IS NOT NULL",
    "evidence": "provenance = 'EXTRACTED' AND evidence = 0",
    "extracted-confidence": "provenance = 'EXTRACTED' AND confidence <> 1",
    "inferred-confidence": "provenance <> 'EXTRACTED' AND coalesce(confidence, 1) = 1",
    "ambiguous-resolution": "provenance = 'AMBIGUOUS' AND resolution IS DISTINCT FROM 'ambiguous'",
}) + ") GROUP BY rule")
def edge_rule_violations(spark, d):
    return C.broken(LINES.read(spark, d), ["edge_id"], C.edge_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("location_violations", "SELECT rule, count(*) AS n FROM (" + rules_sql(LINES.sql, "edge_id", {
    "path": SAFE,
    "positive": "coalesce(start_line < 1, false) OR coalesce(start_column < 1, false) OR coalesce(end_line < 1, false) OR coalesce(end_column < 1, false)",
    "column-without-line": "start_line IS NULL AND (start_column IS NOT NULL OR end_column IS NOT NULL)",
    "end-column-without-line": "end_line IS NULL AND end_column IS NOT NULL",
    "end-without-start": "start_line IS NULL AND end_line IS NOT NULL",
    "order": "end_line < start_line OR (end_line = start_line AND end_column < coalesce(start_column, 1))",
}) + ") GROUP BY rule")
def location_violations(spark, d):
    return C.broken(LINES.read(spark, d), ["edge_id"], C.location_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("metric_violations", rules_sql(RESULTS.sql, "s_suppkey", {
    "analyzed-above-total": "analyzed_files > total_files",
    "percentage-range": "percentage > 1",
    "percentage": "percentage <> CASE WHEN total_files = 0 THEN 1 ELSE analyzed_files / total_files END",
    "node-count": "node_count <> nodes",
    "edge-count": "edge_count <> edges",
    "snapshot-coverage": "total_files <> discovered OR analyzed_files <> analyzed",
}))
def metric_violations(spark, d):
    return C.broken(RESULTS.read(spark, d), ["s_suppkey"], C.metric_rules())


@query("result_violations", rules_sql(RESULTS.sql, "s_suppkey", {
    "schema": "schema_version <> '1.0'",
    "job-id": TRIMMED.format(c="job_id"),
    "analyzer": TRIMMED.format(c="analyzer"),
    "provider": "provider <> 'github'",
    "repository-id": "repository_id = 'github:A/b'",
    "repository-match": "repository_id <> snapshot_repository_id",
    "graph-match": "graph_snapshot <> snapshot",
    "coverage-match": "coverage <> snapshot_coverage",
}))
def result_violations(spark, d):
    return C.broken(RESULTS.read(spark, d), ["s_suppkey"], C.result_rules())


@query("graph_violations", FX + f""", n AS (SELECT id, kind FROM fx_nodes WHERE kind <> 'schema'), e AS (SELECT src, dst, kind FROM fx_edges UNION ALL SELECT src, dst, kind FROM ({LINES.sql}))
SELECT 'src' AS rule, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'dst', count(*) FROM e WHERE dst NOT IN (SELECT id FROM n)
UNION ALL SELECT 'import-source', count(*) FROM e JOIN n ON id = src WHERE e.kind IN ('imports', 'requires') AND n.kind <> 'file'""")
def graph_violations(spark, d):
    """References that fail in the graph without its schema nodes, with the order lines' edges added."""
    e = edges(spark, d).unionByName(LINES.read(spark, d).select("src", "dst", "kind"))
    return C.graph_violations(nodes(spark, d).filter("kind <> 'schema'"), e)


@query("diagnostic_counts", f"""SELECT count(*) FILTER (regexp_matches(diagnostic, '(?i)SYNTAX|PARSE')) AS syntax, count(*) FILTER (regexp_matches(diagnostic, '(?i)IMPORT|UNRESOLVED|MISSING_MODULE|MODULE_NOT_FOUND')) AS unresolved, count(*) FILTER (regexp_matches(diagnostic, '(?i)UNSUPPORTED|FILE_TYPE')) AS unsupported FROM ({INPUTS.sql})""")
def diagnostic_counts(spark, d):
    from graphloom.operators import reports as R

    return R.diagnostic_counts(INPUTS.read(spark, d).select(F.col("diagnostic").alias("code")))
