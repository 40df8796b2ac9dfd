"""Queries of requests that come as JSON, with checks that read it by other functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.operators import contracts as C
from graphloom.operators import node_rules as N
from graphloom.operators import requests as R
from graphloom.plans.registry import query
from graphloom.sources.records import DOCUMENTS, NODE_MANIFEST, NODE_TEXTS, QUERIES, REQUESTS

_BLANK = R.BLANK.replace(r"\x{0B}", r"\v")


def _trimmed(t: str) -> str:
    return f"{t} <> '' AND NOT regexp_matches({t}, '\\A{_BLANK}|{_BLANK}\\z')"


def _strict(t: str, most: int) -> str:
    units = f"length({t}) + len(regexp_extract_all({t}, '[\\x{{10000}}-\\x{{10FFFF}}]'))"
    return f"{_trimmed(t)} AND {units} <= {most} AND NOT regexp_matches({t}, '[\\x00-\\x1F\\x7F]')"


def _text(key: str, of: str = "j") -> str:
    return f"CASE WHEN json_type({of}, '$.{key}') = 'VARCHAR' THEN json_extract_string({of}, '$.{key}') END"


def _number(key: str, of: str = "j") -> str:
    n = f"json_extract_string({of}, '$.{key}')::DOUBLE"
    whole = f"json_type({of}, '$.{key}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    return f"CASE WHEN {whole} THEN CASE WHEN {n} = floor({n}) AND abs({n}) <= {R.SAFE} THEN {n}::BIGINT END END"


def _names(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _list(key: str, known) -> str:
    """Whether a field is a list of known names, with one at least."""
    texts = f"json_extract_string(j, '$.{key}[*]')"
    types = f"json_type(j, '$.{key}[*]')"
    return f"json_type(j, '$.{key}') = 'ARRAY' AND len({texts}) > 0 AND len(list_filter({types}, lambda x: x <> 'VARCHAR')) = 0 AND list_has_all({_names(known)}, {texts})"


_SHAPES = ", ".join(f"('{k}', {_names(('type', *needs))}, {_names(('type', 'budget', *needs, *may))})" for k, (needs, may) in C.QUERY_KEYS.items())

#: own: a query's keys; may: those of its type.
_QUERY_SQL = f"""
WITH shapes(kind, needs, may) AS (VALUES {_SHAPES}),
r AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM ({QUERIES.sql})),
o AS (SELECT event_id, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS j FROM r),
f AS (SELECT event_id, j, json_keys(j) AS own, {_text("type")} AS type, {_text("text")} AS text, {_text("nodeId")} AS node_id,
             {_text("from")} AS from_id, {_text("to")} AS to_id, {_text("direction")} AS direction,
             {_number("cursor")} AS cursor, {_number("maxDepth")} AS max_depth,
             CASE WHEN json_type(j, '$.budget') = 'OBJECT' THEN json_extract(j, '$.budget') END AS b FROM o),
g AS (SELECT f.*, needs, may, json_keys(b) AS b_own, {_number("maxCost", "b")} AS max_cost, {_number("maxResults", "b")} AS max_results, {_number("maxTimeMs", "b")} AS max_time
      FROM f LEFT JOIN shapes ON kind = type),
broken AS (
  SELECT event_id, 'object' AS rule FROM g WHERE own IS NULL
  UNION ALL SELECT event_id, 'type' FROM g WHERE own IS NOT NULL AND needs IS NULL
  UNION ALL SELECT event_id, 'unknown-key' FROM g WHERE NOT list_has_all(may, own)
  UNION ALL SELECT event_id, 'missing-key' FROM g WHERE NOT list_has_all(own, needs)
  UNION ALL SELECT event_id, 'text' FROM g WHERE list_contains(may, 'text') AND list_contains(own, 'text') AND NOT coalesce({_strict("text", C.SEARCH_LENGTH)}, false)
  UNION ALL SELECT event_id, 'node-id' FROM g WHERE list_contains(may, 'nodeId') AND list_contains(own, 'nodeId') AND NOT coalesce({_strict("node_id", C.TEXT_LENGTH)}, false)
  UNION ALL SELECT event_id, 'node-id' FROM g WHERE list_contains(may, 'from')
    AND ((list_contains(own, 'from') AND NOT coalesce({_strict("from_id", C.TEXT_LENGTH)}, false)) OR (list_contains(own, 'to') AND NOT coalesce({_strict("to_id", C.TEXT_LENGTH)}, false)))
  UNION ALL SELECT event_id, 'kinds' FROM g WHERE list_contains(may, 'kinds') AND list_contains(own, 'kinds') AND NOT coalesce({_list("kinds", S.ASKED_KINDS)}, false)
  UNION ALL SELECT event_id, 'edge-kinds' FROM g WHERE list_contains(may, 'edgeKinds') AND list_contains(own, 'edgeKinds') AND NOT coalesce({_list("edgeKinds", S.EDGE_KINDS)}, false)
  UNION ALL SELECT event_id, 'direction' FROM g WHERE list_contains(may, 'direction') AND list_contains(own, 'direction') AND NOT coalesce(direction IN {R.DIRECTIONS}, false)
  UNION ALL SELECT event_id, 'cursor' FROM g WHERE list_contains(may, 'cursor') AND list_contains(own, 'cursor') AND NOT coalesce(cursor BETWEEN 0 AND {S.MAX_COST[1]}, false)
  UNION ALL SELECT event_id, 'depth' FROM g WHERE list_contains(may, 'maxDepth') AND list_contains(own, 'maxDepth') AND NOT coalesce(max_depth BETWEEN 1 AND {S.MAX_DEPTH[1]}, false)
  UNION ALL SELECT event_id, 'budget-key' FROM g WHERE list_contains(own, 'budget') AND NOT coalesce(list_has_all({_names(('maxCost', 'maxResults', 'maxTimeMs'))}, b_own), false)
  UNION ALL SELECT event_id, 'budget' FROM g WHERE (list_contains(b_own, 'maxCost') AND NOT coalesce(max_cost BETWEEN 1 AND {S.MAX_COST[1]}, false))
    OR (list_contains(b_own, 'maxResults') AND NOT coalesce(max_results BETWEEN 1 AND {S.MAX_RESULTS[1]}, false))
    OR (list_contains(b_own, 'maxTimeMs') AND NOT coalesce(max_time BETWEEN 1 AND {C.MAX_TIME[1]}, false)))"""


@query("query_violations", f"{_QUERY_SQL} SELECT event_id, rule FROM broken")
def query_violations(spark, d):
    """Rules that graph queries break."""
    return R.query_violations(QUERIES.read(spark, d), "event_id", "body")


def _sorted(key: str) -> str:
    return f"CASE WHEN list_contains(own, '{key}') THEN array_to_string(list_sort(list_distinct(json_extract_string(j, '$.{key}[*]'))), ',') END"


@query("parsed_queries", f"""{_QUERY_SQL}
SELECT event_id, type, text, node_id, from_id, to_id, CASE WHEN list_contains(may, 'direction') THEN coalesce(direction, 'both') END AS direction,
       {_sorted("kinds")} AS kinds, {_sorted("edgeKinds")} AS edge_kinds,
       CASE WHEN list_contains(may, 'cursor') THEN coalesce(cursor, 0) END AS cursor, CASE WHEN list_contains(may, 'maxDepth') THEN coalesce(max_depth, {S.MAX_DEPTH[0]}) END AS max_depth,
       coalesce(max_cost, {S.MAX_COST[0]}) AS max_cost, coalesce(max_results, {S.MAX_RESULTS[0]}) AS max_results, coalesce(max_time, {C.MAX_TIME[0]}) AS max_time
FROM g WHERE event_id NOT IN (SELECT event_id FROM broken)""")
def parsed_queries(spark, d):
    """Graph queries that keep all rules, with defaults, and lists in order with each item once."""
    q = R.graph_queries(QUERIES.read(spark, d), "event_id", "body").filter("query IS NOT NULL").select("event_id", "query.*")
    lists = {k: F.array_join(k, ",") for k in ("kinds", "edge_kinds")}
    return q.withColumns(lists).withColumnsRenamed({"from": "from_id", "to": "to_id"})


def _request_sql(kind: str, fields: dict[str, str], rules: dict[str, str], shown: str) -> str:
    """fields: SQL of values by name; rules: conditions of failing; shown: what a good request gives."""
    shape = R.REQUESTS[kind]
    values = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
    tests = {
        "object": "own IS NULL",
        "unknown-key": f"NOT list_has_all({_names((*shape.required, *shape.optional))}, own)",
        "missing-key": f"NOT list_has_all(own, {_names(shape.required)})",
        **rules,
    }
    found = ", ".join(f"CASE WHEN {test} THEN '{rule}' END" for rule, test in sorted(tests.items()))
    return f"""WITH r AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM ({REQUESTS[kind].sql})),
o AS (SELECT event_id, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS j FROM r),
f AS (SELECT event_id, j, json_keys(j) AS own, {values} FROM o),
b AS (SELECT *, array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ',') AS violations FROM f)
SELECT event_id, violations, CASE WHEN violations = '' THEN {shown} END AS request FROM b"""


def _wrong(key: str, good: str) -> str:
    return f"list_contains(own, '{key}') AND NOT coalesce({good}, false)"


def _requests(spark, d, kind: str, shown: dict[str, str]):
    rows = R.requests(REQUESTS[kind].read(spark, d), kind, "body", shown)
    request = F.when(F.col("request").isNotNull(), F.concat_ws("|", *[F.coalesce(f"request.{name}", F.lit("-")) for name in shown.values()]))
    return rows.select("event_id", F.array_join("violations", ",").alias("violations"), request.alias("request"))


@query("create_requests", _request_sql(
    "create",
    {"url": _text("repositoryUrl"), "ref": _text("ref")},
    {
        "url": _wrong("repositoryUrl", f"{_trimmed('url')} AND regexp_matches(url, '{R.REQUEST_URL}')"),
        "ref": _wrong("ref", _trimmed("ref")),
    },
    "url || '|' || coalesce(ref, '-')",
))
def create_requests(spark, d):
    """Clients' requests for a job."""
    return _requests(spark, d, "create", {"repositoryUrl": "url", "ref": "ref"})


@query("create_inputs", _request_sql(
    "input",
    {"version": _text("analyzerVersion"), "idem": _text("idempotencyKey"), "rid": _text("repositoryId"), "ref": _text("requestedRef")},
    {
        "text": " OR ".join(f"({_wrong(k, _trimmed(n))})" for k, n in (("analyzerVersion", "version"), ("idempotencyKey", "idem"), ("requestedRef", "ref"))),
        "repository-id": _wrong("repositoryId", f"regexp_matches(rid, '{C.REPOSITORY_ID}')"),
    },
    "version || '|' || idem || '|' || rid || '|' || ref",
))
def create_inputs(spark, d):
    """What the service asks the store to create."""
    return _requests(spark, d, "input", {"analyzerVersion": "version", "idempotencyKey": "idem", "repositoryId": "rid", "requestedRef": "ref"})


@query("result_responses", _request_sql(
    "response",
    {"job": _text("jobId"), "status": _text("status")},
    {
        "job-id": _wrong("jobId", _trimmed("job")),
        "status": _wrong("status", "status = 'succeeded'"),
        "result": _wrong("result", "json_type(j, '$.result') = 'OBJECT'"),
    },
    "job",
))
def result_responses(spark, d):
    """Results that come back to a client."""
    return _requests(spark, d, "response", {"jobId": "job"})


@query("queue_messages", _request_sql(
    "message",
    {"version": _text("schemaVersion"), "job": _text("jobId"), "stage": _text("expectedStage"), "cursor": _text("cursor")},
    {
        "schema": _wrong("schemaVersion", "version = '1.0'"),
        "job-id": _wrong("jobId", _trimmed("job")),
        "stage": _wrong("expectedStage", "stage IN ('inventory', 'fetch-content', 'analyze')"),
        "cursor": _wrong("cursor", _trimmed("cursor")),
    },
    "job || '|' || stage || '|' || coalesce(cursor, '-')",
))
def queue_messages(spark, d):
    """Messages of deliveries; what is none breaks a rule, and is acknowledged and dropped."""
    return _requests(spark, d, "message", {"jobId": "job", "expectedStage": "stage", "cursor": "cursor"})


#: The forms in order of their keys, by hand.
_CANONICAL = (
    '{"a":true,"b":[{"a":null,"z":NUMBER}]}',
    '{"e":-5,"k":{"x":"it\'s","y":{"c":{},"d":[]}}}',
    '[{"a":[{"c":[{"e":2,"f":1}],"d":0}],"b":1},"t",false]',
    '{"Key":"A","_":"é","key":"a","key two":"NUMBER"}',
    '"text"',
)


def _canonical_sql() -> str:
    from graphloom.sources.records import DOCUMENT_FORMS, texts_of

    forms = (*_CANONICAL, *[""] * (len(DOCUMENT_FORMS) - len(_CANONICAL)))
    return f"SELECT event_id, nullif({texts_of(forms)}, '') AS canonical FROM events"


@query("canonical_json", _canonical_sql())
def canonical_json(spark, d):
    """JSON of any nesting with its keys in order."""
    return DOCUMENTS.read(spark, d).select("event_id", R.canonical_json(F.col("body")).alias("canonical"))


def _safe(t: str) -> str:
    return f"{_trimmed(t)} AND NOT regexp_matches({t}, '[\\x00-\\x1F\\x7F]|^/|/$|\\\\|//|(^|/)\\.\\.?(/|$)')"


def _strict_text(t: str) -> str:
    return f"coalesce({_trimmed(t)} AND NOT regexp_matches({t}, '[\\x00-\\x1F\\x7F]'), false)"


def _has(key: str) -> str:
    return f"list_contains(mine, '{key}') AND list_contains(may, '{key}')"


def _items(key: str) -> str:
    """Whether a field of the metadata is a list of texts with something in them."""
    types, texts = f"json_type(m, '$.{key}[*]')", f"json_extract_string(m, '$.{key}[*]')"
    return f"json_type(m, '$.{key}') = 'ARRAY' AND len(list_filter({types}, lambda x: x <> 'VARCHAR')) = 0 AND len(list_filter({texts}, lambda x: trim(x) = '')) = 0"


def _node_sql() -> str:
    shapes = ", ".join(f"('{k}', {_names(needs)}, {_names((*needs, *may))})" for k, (needs, may) in N.METADATA.items())
    texts = " OR ".join(f"({_has(k)} AND NOT {_strict_text('(' + _text(k, 'm') + ')')})" for k in N.TEXTS)
    flags = " OR ".join(f"({_has(k)} AND json_type(m, '$.{k}') <> 'BOOLEAN')" for k in ("exported", "async"))
    lists = " OR ".join(f"({_has(k)} AND NOT coalesce({_items(k)}, false))" for k in ("methods", "fields"))
    numbers = " OR ".join(f"(list_contains(place, '{k}') AND NOT coalesce(({_number(k, 'l')}) >= 1, false))" for k in N.PLACES)
    visible = ", ".join(f"'{x}'" for x in N.VISIBILITIES)
    tests = {
        "object": "own IS NULL",
        "unknown-key": f"NOT list_has_all({_names(('id', 'kind', 'name', 'metadata', 'location'))}, own)",
        "missing-key": f"NOT list_has_all(own, {_names(('id', 'kind', 'name', 'metadata'))})",
        "kind": "own IS NOT NULL AND may IS NULL",
        "id": f"list_contains(own, 'id') AND NOT {_strict_text('id')}",
        "name": f"list_contains(own, 'name') AND NOT {_strict_text('name')}",
        "metadata": "list_contains(own, 'metadata') AND mine IS NULL",
        "metadata-unknown-key": "NOT list_has_all(may, mine)",
        "metadata-missing-key": "NOT list_has_all(mine, needs)",
        "metadata-text": f"{texts} OR (kind = 'route' AND {_has('path')} AND NOT {_strict_text('path')})",
        "metadata-path": f"(kind = 'file' AND {_has('path')} AND NOT coalesce({_safe('path')}, false)) OR ({_has('workspacePath')} AND NOT coalesce({_safe('workspace')}, false))",
        "metadata-manifest": f"kind = 'file' AND coalesce({_safe('path')}, false) AND path NOT IN (SELECT path FROM manifest)",
        "size": f"{_has('sizeBytes')} AND NOT coalesce(({_number('sizeBytes', 'm')}) >= 0, false)",
        "sha256": f"{_has('contentSha256')} AND NOT coalesce(regexp_matches({_text('contentSha256', 'm')}, '{C.SHA256}'), false)",
        "visibility": f"{_has('visibility')} AND NOT coalesce(({_text('visibility', 'm')}) IN ({visible}), false)",
        "flag": flags,
        "list": lists,
        "location": "list_contains(own, 'location') AND place IS NULL",
        "location-key": f"NOT list_has_all({_names(('path', *N.PLACES))}, place) OR NOT list_contains(place, 'path')",
        "location-path": f"list_contains(place, 'path') AND NOT coalesce({_safe('at_path')}, false)",
        "location-manifest": f"list_contains(place, 'path') AND coalesce({_safe('at_path')}, false) AND at_path NOT IN (SELECT path FROM manifest)",
        "location-number": numbers,
        "location-start": "(list_has_any(place, ['startColumn', 'endColumn', 'endLine']) AND NOT list_contains(place, 'startLine')) OR (list_contains(place, 'endColumn') AND NOT list_contains(place, 'endLine'))",
        "location-order": f"({_number('endLine', 'l')}) < ({_number('startLine', 'l')}) OR (({_number('endLine', 'l')}) = ({_number('startLine', 'l')}) AND ({_number('endColumn', 'l')}) < coalesce({_number('startColumn', 'l')}, 1))",
    }
    rules = " UNION ALL ".join(f"SELECT p_partkey, '{rule}' AS rule FROM g WHERE {test}" for rule, test in tests.items())
    return f"""
WITH manifest AS ({NODE_MANIFEST}), shapes(k, needs, may) AS (VALUES {shapes}),
r AS (SELECT p_partkey, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM ({NODE_TEXTS.sql})),
o AS (SELECT p_partkey, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS j FROM r),
f AS (SELECT p_partkey, j, json_keys(j) AS own, {_text("kind")} AS kind, {_text("id")} AS id, {_text("name")} AS name,
             CASE WHEN json_type(j, '$.metadata') = 'OBJECT' THEN json_extract(j, '$.metadata') END AS m, CASE WHEN json_type(j, '$.location') = 'OBJECT' THEN json_extract(j, '$.location') END AS l FROM o),
g AS (SELECT f.*, needs, may, json_keys(m) AS mine, json_keys(l) AS place, {_text("path", "m")} AS path, {_text("workspacePath", "m")} AS workspace, {_text("path", "l")} AS at_path FROM f LEFT JOIN shapes ON k = kind)
{rules}"""


@query("node_rule_violations", _node_sql())
def node_rule_violations(spark, d):
    """Rules that nodes break: kinds, metadata of each kind, locations, files that no manifest has."""
    manifest = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 2 = 0").selectExpr("'src/' || CAST(p_partkey AS STRING) || '.ts' AS path")
    return N.node_violations(NODE_TEXTS.read(spark, d), manifest, "p_partkey", "body")
