"""Rules of records: manifests, snapshots, jobs, messages, graphs and queries.

Each check returns its rows' keys with the rules that they break, a row for each; nothing is thrown away and
nothing stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom import schema as S

#: Limits of a snapshot.
ENTRIES, ANALYZED, FILE_BYTES, TOTAL_BYTES = 10_000, 100, 120_000, 10_000_000
#: Patterns of identifiers.
SHA1, SHA256 = r"\A[0-9a-f]{40}\z", r"\A[0-9a-f]{64}\z"
SEGMENT = r"[A-Za-z0-9](?:[A-Za-z0-9._-]{0,98}[A-Za-z0-9_-])?"
REPOSITORY_ID = r"\Agithub:[a-z0-9](?:[a-z0-9._-]{0,98}[a-z0-9_-])?/[a-z0-9](?:[a-z0-9._-]{0,98}[a-z0-9_-])?\z"
ADDRESS = r"\Ahttps://github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?\z"
TIMESTAMP = r"\A\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}|24:00:00\.000)Z\z"
#: Kinds of entries with their modes.
MODES = {"blob": ("100644", "100755"), "symlink": ("120000",), "submodule": ("160000",)}
#: States and stages of jobs, stages of messages, and codes of errors.
STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
TERMINAL = ("succeeded", "failed", "cancelled")
STAGES = ("inventory", "fetch-content", "analyze", "complete")
ERRORS = ("invalid_repository_url", "invalid_ref", "repository_not_found", "repository_unavailable", "github_rate_limited", "inventory_limit_exceeded", "content_limit_exceeded", "invalid_provider_response", "analysis_failed", "cancelled", "internal_error")
#: Provider failures that are tried again.
PASSING = ("aborted", "network", "server_error")
#: Modes and results of imports.
IMPORT_MODES = ("static", "dynamic", "require", "type")
RESOLUTIONS = ("resolved", "unresolved", "ambiguous", "external")
#: What each kind of query may hold besides its kind and budget, with what it must.
QUERY_KEYS = {
    "search": (("text",), ("kinds", "cursor")),
    "node": (("nodeId",), ()),
    "explain": (("nodeId",), ()),
    "neighbors": (("nodeId",), ("direction", "edgeKinds", "cursor")),
    "impact": (("nodeId",), ("direction", "edgeKinds", "maxDepth")),
    "shortestPath": (("from", "to"), ("direction", "edgeKinds", "maxDepth")),
}
SEARCH_LENGTH, TEXT_LENGTH, MAX_TIME = 256, 1024, (100, 2_000)


def broken(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule of each rule whose condition of failing holds; an unknown condition doesn't."""
    found = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("rule"))


def required_text(c: Column) -> Column:
    """Whether text is there, without white space around it."""
    return c.isNotNull() & (F.trim(c) != "") & ~c.rlike(r"\A\s|\s\z")


def strict_text(c: Column, most: int = TEXT_LENGTH) -> Column:
    """The same, of a largest length and without control characters."""
    return required_text(c) & (F.length(c) <= most) & ~c.rlike(r"[\x00-\x1F\x7F]")


def valid_timestamp(c: Column) -> Column:
    return F.coalesce(c.rlike(TIMESTAMP), F.lit(False))


def valid_ref(c: Column) -> Column:
    """Whether a reference to a branch, tag or commit is well formed."""
    bad = (c == "") | (F.length(c) > 1024) | c.startswith("/") | c.endswith("/") | c.contains("..") | c.contains("//") | c.contains("@{") | c.rlike(r"[\x00-\x20~^:?*\\\[\]]")
    return F.coalesce(~bad, F.lit(False))


def repository_of(url: Column) -> Column:
    """Owner and name (struct owner, repo) of a canonical address, null for any other; https and the host count
    whatever their case, and there is no user, port, query or fragment."""
    plain = F.regexp_replace(url, r"\A(?i:https://github\.com)/", "https://github.com/")
    owner, repo = F.regexp_extract(plain, ADDRESS, 1), F.regexp_extract(plain, ADDRESS, 2)
    whole = rf"\A{SEGMENT}\z"
    return F.when(plain.rlike(ADDRESS) & owner.rlike(whole) & repo.rlike(whole), F.struct(owner.alias("owner"), repo.alias("repo")))


def repository_id(owner: Column, repo: Column) -> Column:
    return F.concat(F.lit("github:"), F.lower(owner), F.lit("/"), F.lower(repo))


def canonical_url(rid: Column) -> Column:
    """Address of a repository id."""
    return F.concat(F.lit("https://github.com/"), F.substring_index(rid, ":", -1))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def classify_entry(mode: Column, type_: Column) -> Column:
    """Kind of a tree's entry; null for one that no manifest knows."""
    return F.when((mode == "120000") & (type_ == "blob"), "symlink").when((mode == "160000") & (type_ == "commit"), "submodule").when(type_.isin("blob", "tree"), type_)


def entry_rules() -> dict[str, Column]:
    """Rules of manifest entries (path, kind, mode, sha, size, eligible, reason, content_key, content_hash)."""
    kind, mode = F.col("kind"), F.col("mode")
    paired = F.lit(False)
    for k, modes in MODES.items():
        paired = paired | ((kind == k) & mode.isin(*modes))
    content = F.col("content_key").isNotNull() | F.col("content_hash").isNotNull()
    return {
        "kind": ~kind.isin(*MODES),
        "mode": ~paired,
        "path": ~X.safe_path(F.col("path")),
        "sha": ~F.coalesce(F.col("sha").rlike(SHA1), F.lit(False)),
        "size": F.coalesce(F.col("size") < 0, F.lit(True)),
        "eligible-kind": (kind != "blob") & F.col("eligible"),
        "reason": F.col("reason").isNotNull() & ~required_text(F.col("reason")),
        "reason-of-eligible": F.col("eligible") & F.col("reason").isNotNull(),
        "content-hash": F.col("content_hash").isNotNull() & ~F.col("content_hash").rlike(SHA256),
        "content-of-ineligible": ~F.col("eligible") & content,
    }


def snapshot_violations(entries: DataFrame, coverage: DataFrame) -> DataFrame:
    """snapshot, rule: what a snapshot's entries and its coverage(snapshot, discovered, analyzed, skipped, bytes,
    analyzed_bytes) break together."""
    per = entries.groupBy("snapshot").agg(F.count(F.lit(1)).alias("entries"), F.count_if("eligible").alias("eligible"), F.bool_or(F.col("eligible") & (F.col("size") > FILE_BYTES)).alias("too_large"))
    again = entries.groupBy("snapshot", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("snapshot").distinct().withColumn("again", F.lit(True))
    rows = per.join(again, "snapshot", "left").join(coverage, "snapshot", "left")
    return broken(
        rows,
        ["snapshot"],
        {
            "entries-limit": F.col("entries") > ENTRIES,
            "duplicate-paths": F.col("again"),
            "eligible-limit": F.col("eligible") > ANALYZED,
            "file-limit": F.col("too_large"),
            "coverage-files": F.col("analyzed") + F.col("skipped") > F.col("discovered"),
            "coverage-bytes": F.col("analyzed_bytes") > F.col("bytes"),
            "coverage-inventory": F.col("discovered") > ENTRIES,
            "coverage-analyzed": F.col("analyzed") > ANALYZED,
            "coverage-total": F.col("analyzed_bytes") > TOTAL_BYTES,
            "discovered-below-entries": F.col("discovered") < F.col("entries"),
            "analyzed-above-eligible": F.col("analyzed") > F.col("eligible"),
        },
    )


IDENTITY = ("snapshot", "provider", "repository_id", "commit_sha", "tree_sha")


def same_snapshots(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, same: whether two versions of a row name one snapshot; the reference asked for may differ."""
    other = right.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in IDENTITY])
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, key).select(key, same.alias("same"))


def job_rules() -> dict[str, Column]:
    """Rules of jobs (job_id, status, stage, done, total, error_code, error_text, retry, created, completed)."""
    status, error = F.col("status"), F.col("error_code").isNotNull()
    return {
        "job-id": ~required_text(F.col("job_id")),
        "status": ~status.isin(*STATUSES),
        "stage": ~F.col("stage").isin(*STAGES),
        "units": (F.col("done") < 0) | (F.col("total") < 0),
        "done-above-total": F.col("done") > F.col("total"),
        "error-code": error & ~F.col("error_code").isin(*ERRORS),
        "error-text": error & ~required_text(F.col("error_text")),
        "error-retry": error & F.col("retry").isNull(),
        "failed-without-error": (status == "failed") & ~error,
        "error-without-failure": (status != "failed") & error,
        "succeeded-before-complete": (status == "succeeded") & (F.col("stage") != "complete"),
        "terminal-without-end": status.isin(*TERMINAL) & F.col("completed").isNull(),
        "created": ~valid_timestamp(F.col("created")),
        "completed": F.col("completed").isNotNull() & ~valid_timestamp(F.col("completed")),
    }


def stored_job_rules() -> dict[str, Column]:
    """What the job table itself refuses."""
    error = [F.col(c) for c in ("error_code", "error_text", "retry")]
    none, every = error[0].isNull(), error[0].isNotNull()
    for c in error[1:]:
        none, every = none & c.isNull(), every & c.isNotNull()
    return {
        "status": ~F.col("status").isin(*STATUSES),
        "stage": ~F.col("stage").isin(*STAGES),
        "units": (F.col("done") < 0) | (F.col("total") < 0) | (F.col("done") > F.col("total")),
        "error-fields": ~none & ~every,
        "succeeded-complete": (F.col("status") == "succeeded") & (F.col("stage") != "complete"),
    }




def failure(code: Column) -> Column:
    """What a provider's failure makes of a job (struct code, retry); null where the delivery is tried again.
    A null code is a failure of our own."""
    kept = F.when(code.isNull(), "analysis_failed").when(code == "not_found", "repository_not_found").when(code == "rate_limited", "rate_limited").otherwise("invalid_provider_response")
    return F.when(code.isNull() | ~code.isin(*PASSING), F.struct(kept.alias("code"), F.lit(False).alias("retry")))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait by a header: a number, or a date after now; null for anything else."""
    seconds = F.when(value.rlike(r"\A\s*\d+(\.\d+)?\s*\z"), F.trim(value).cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(value, r"\A\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    left = F.unix_timestamp(date) - F.unix_timestamp(now)
    return F.coalesce(seconds, F.when(left.isNotNull(), F.greatest(left, F.lit(0))).cast("double"))


def status_projection(jobs: DataFrame) -> DataFrame:
    """What a job's owner may see; an error only with all of its fields."""
    whole = F.col("error_code").isNotNull() & F.col("error_text").isNotNull() & F.col("retry").isNotNull()
    error = F.when(whole, F.struct(F.col("error_code").alias("code"), F.col("error_text").alias("message"), F.col("retry").alias("retryable")))
    return jobs.select("event_id", F.col("job_id").alias("analysis_id"), "status", "stage", "done", "total", error.alias("error"))


def import_rules() -> dict[str, Column]:
    """Rules of imports (mode, specifier, type_only, resolution, candidates)."""
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return {
        "mode": ~F.col("mode").isin(*IMPORT_MODES),
        "resolution": ~F.col("resolution").isin(*RESOLUTIONS),
        "specifier": ~strict_text(F.col("specifier")),
        "type-only": (F.col("mode") == "type") & ~F.col("type_only"),
        "ambiguous-candidates": (F.col("resolution") == "ambiguous") & (n < 2),
        "unresolved-candidates": (F.col("resolution") == "unresolved") & (n > 0),
    }


def edge_rules() -> dict[str, Column]:
    """Rules of edges (kind, provenance, confidence, evidence: how many, resolution: of an import's metadata)."""
    prov, conf, imports = F.col("provenance"), F.col("confidence"), F.col("kind").isin("imports", "requires")
    return {
        "kind": ~F.col("kind").isin(*S.EDGE_KINDS),
        "provenance": ~prov.isin(*S.PROVENANCES),
        "confidence-range": (conf < 0) | (conf > 1),
        "metadata-missing": imports & F.col("resolution").isNull(),
        "metadata-forbidden": ~imports & F.col("resolution").isNotNull(),
        "evidence": (prov == "EXTRACTED") & (F.col("evidence") == 0),
        "extracted-confidence": (prov == "EXTRACTED") & (conf != 1),
        "inferred-confidence": (prov != "EXTRACTED") & (conf.isNull() | (conf == 1)),
        "ambiguous-resolution": (prov == "AMBIGUOUS") & ~F.coalesce(F.col("resolution") == "ambiguous", F.lit(False)),
    }


def location_rules() -> dict[str, Column]:
    """Rules of locations (path, start_line, start_column, end_line, end_column)."""
    a, b, c, d = (F.col(x) for x in ("start_line", "start_column", "end_line", "end_column"))
    return {
        "path": ~X.safe_path(F.col("path")),
        "positive": (a < 1) | (b < 1) | (c < 1) | (d < 1),
        "column-without-line": (b.isNotNull() | d.isNotNull()) & a.isNull(),
        "end-column-without-line": d.isNotNull() & c.isNull(),
        "end-without-start": c.isNotNull() & a.isNull(),
        "order": (c < a) | ((c == a) & (d < F.coalesce(b, F.lit(1)))),
    }


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, n: how often a graph's references fail: repeated node ids, ends that are no node, and imports that
    leave something else than a file."""
    kinds = nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")).distinct()
    ends = edges.join(kinds, "src", "left").join(nodes.select(F.col("id").alias("dst"), F.lit(True).alias("dst_known")).distinct(), "dst", "left")
    rules = {"src": F.col("src_kind").isNull(), "dst": F.col("dst_known").isNull(), "import-source": F.col("kind").isin("imports", "requires") & (F.col("src_kind") != "file")}
    counts = broken(ends, [], rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(duplicates(nodes.select("id"), "id").agg(F.lit("duplicate-id").alias("rule"), F.count(F.lit(1)).alias("n")).filter("n > 0"))


def metric_rules() -> dict[str, Column]:
    """Rules of a graph's coverage and metrics against what it holds and its snapshot says."""
    share = F.when(F.col("total_files") == 0, 1.0).otherwise(F.col("analyzed_files") / F.col("total_files"))
    return {
        "analyzed-above-total": F.col("analyzed_files") > F.col("total_files"),
        "percentage-range": (F.col("percentage") < 0) | (F.col("percentage") > 1),
        "percentage": F.col("percentage") != share,
        "node-count": F.col("node_count") != F.col("nodes"),
        "edge-count": F.col("edge_count") != F.col("edges"),
        "snapshot-coverage": (F.col("total_files") != F.col("discovered")) | (F.col("analyzed_files") != F.col("analyzed")),
    }


def result_rules() -> dict[str, Column]:
    """Rules of a result's envelope against its snapshot, repository and graph."""
    return {
        "schema": F.col("schema_version") != "1.0",
        "job-id": ~required_text(F.col("job_id")),
        "analyzer": ~required_text(F.col("analyzer")),
        "provider": F.col("provider") != "github",
        "repository-id": ~F.coalesce(F.col("repository_id").rlike(REPOSITORY_ID), F.lit(False)),
        "repository-match": F.col("repository_id") != F.col("snapshot_repository_id"),
        "graph-match": F.col("graph_snapshot").isNotNull() & (F.col("graph_snapshot") != F.col("snapshot")),
        "coverage-match": F.col("coverage") != F.col("snapshot_coverage"),
    }
