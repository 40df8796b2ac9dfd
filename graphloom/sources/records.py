"""Records of repositories, snapshots, jobs and queries made of the driver's tables, with rows that break each
rule.  The projections are plain SQL that Spark and the SQL checks read alike; rules are stated elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Records:
    """A projection of one table."""

    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in self.columns.items()) + f" FROM {self.table}"


_B = "CAST(substr(p_brand, 7) AS INT)"
_K = "(p_partkey % 50)"
_P = "CAST(p_partkey AS STRING)"

#: Files of 25 repositories: position, path and bytes.
FILES = Records(
    "part",
    repo="p_brand",
    pos="p_partkey",
    size="p_partkey * p_size",
    path=f"""CASE WHEN {_K} = 0 AND {_B} % 2 = 0 THEN 'SECURITY.md' WHEN {_K} = 1 AND {_B} % 3 = 0 THEN 'conf/.env' WHEN {_K} = 2 AND {_B} % 2 = 1 THEN '.github/workflows/ci-' || {_P} || '.yml'
    WHEN {_K} = 3 AND {_B} % 4 <> 1 THEN 'package-lock.json' WHEN {_K} IN (4, 5, 6) AND {_B} % 5 <> 1 THEN 'src/__tests__/' || p_type || '-' || {_P} || '.ts' WHEN {_K} = 7 THEN 'README.md'
    WHEN {_K} = 8 THEN 'docs/guide-' || {_P} || '.md' WHEN {_K} = 9 THEN 'vite.config.ts' WHEN {_K} = 10 THEN 'Dockerfile' WHEN {_K} = 11 THEN 'img/logo-' || {_P} || '.PNG'
    WHEN {_K} = 12 THEN 'src/Index.ts' WHEN {_K} = 13 AND {_B} % 2 = 0 THEN 'lib/' || p_type || '.spec.js' WHEN {_K} = 14 THEN 'node_modules/x/' || {_P} || '.js' WHEN {_K} = 15 THEN 'build/out-' || {_P} || '.ts'
    WHEN {_B} % 4 = 0 THEN 'src/' || {_P} || '.ts' WHEN p_size % 4 = 0 THEN 'src/' || p_type || '.py' WHEN p_size % 4 = 1 THEN 'lib/' || p_type || '/' || {_P} || '.go' WHEN p_size % 4 = 2 THEN 'web/' || {_P} || '.vue' ELSE 'data/' || {_P} || '.csv' END""",
)

_L = "l_linenumber"
_KEY = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"

#: Manifest entries, of which many break a rule.
ENTRIES = Records(
    "lineitem",
    snapshot="l_suppkey",
    path=f"""CASE WHEN l_orderkey % 17 = 0 THEN '/' || {_KEY} WHEN l_orderkey % 17 = 1 THEN {_KEY} || '/' WHEN l_orderkey % 17 = 2 THEN 'a/../' || {_KEY} WHEN l_orderkey % 17 = 3 THEN 'a//' || {_KEY} WHEN l_orderkey % 17 = 4 THEN 'same' ELSE 'src/' || {_KEY} || '.ts' END""",
    kind=f"CASE {_L} WHEN 1 THEN 'symlink' WHEN 2 THEN 'submodule' WHEN 3 THEN 'tree' ELSE 'blob' END",
    mode=f"CASE WHEN {_L} = 1 THEN '120000' WHEN {_L} = 2 AND l_partkey % 3 <> 0 THEN '160000' WHEN {_L} = 4 THEN '100755' WHEN {_L} = 5 AND l_partkey % 7 = 0 THEN '120000' ELSE '100644' END",
    sha=f"CASE WHEN l_partkey % 13 = 0 THEN upper(sha1({_KEY})) WHEN l_partkey % 13 = 1 THEN 'abc' ELSE sha1({_KEY}) END",
    size="CASE WHEN l_partkey % 19 = 0 THEN -1 WHEN l_partkey % 19 = 1 THEN 130000 ELSE CAST(floor(l_quantity) * 100 AS BIGINT) END",
    eligible="l_returnflag <> 'R'",
    reason="CASE WHEN l_returnflag = 'R' THEN 'kind' WHEN l_orderkey % 23 = 0 THEN 'late' END",
    content_key="CASE WHEN l_partkey % 4 = 0 THEN 'content/x' END",
    content_hash="CASE WHEN l_partkey % 4 = 0 AND l_partkey % 8 <> 0 THEN lower(sha1('x')) || substr(sha1('y'), 1, 24) WHEN l_partkey % 8 = 0 THEN 'short' END",
)

_T = "substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || '.000Z'"

#: States of jobs, of which many break a rule.
JOBS = Records(
    "events",
    event_id="event_id",
    job_id="'job_' || CAST(user_id AS STRING)",
    status="CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'paused' END",
    stage="CASE user_id % 5 WHEN 0 THEN 'inventory' WHEN 1 THEN 'fetch-content' WHEN 2 THEN 'analyze' WHEN 3 THEN 'complete' ELSE 'rest' END",
    done="CAST(floor(value) AS BIGINT) - 1",
    total="event_id % 100",
    error_code="CASE WHEN event_id % 7 = 3 THEN 'analysis_failed' WHEN event_id % 7 = 5 THEN 'odd' END",
    error_text="CASE WHEN event_id % 7 IN (3, 5) AND event_id % 4 <> 0 THEN 'it broke' END",
    retry="CASE WHEN event_id % 7 IN (3, 5) AND event_id % 5 <> 0 THEN event_id % 2 = 0 END",
    created=f"CASE WHEN event_id % 29 = 0 THEN substr({_T}, 1, 19) WHEN event_id % 29 = 1 THEN '2024-02-31T00:00:00.000Z' WHEN event_id % 29 = 2 THEN '2024-13-01T00:00:00.000Z' ELSE {_T} END",
    completed=f"CASE WHEN event_id % 3 <> 1 THEN {_T} END",
    idem="'key-' || CAST(event_id % 1000 AS STRING)",
)

#: References, addresses and repository ids as users type them.
INPUTS = Records(
    "events",
    event_id="event_id",
    ref="CASE event_id % 11 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/' || CAST(user_id AS STRING) WHEN 2 THEN '/lead' WHEN 3 THEN 'trail/' WHEN 4 THEN 'a..b' WHEN 5 THEN 'a//b' WHEN 6 THEN 'x@{1}' WHEN 7 THEN 'a b' WHEN 8 THEN 'a~1' WHEN 9 THEN '' ELSE 'v1.' || CAST(event_id AS STRING) END",
    url="""CASE event_id % 13 WHEN 0 THEN 'https://github.com/Acme/Tool' WHEN 1 THEN 'https://github.com/acme/tool-' || CAST(user_id AS STRING) || '.git' WHEN 2 THEN 'http://github.com/acme/tool' WHEN 3 THEN 'https://github.com:443/acme/tool' WHEN 4 THEN 'https://u@github.com/acme/tool'
    WHEN 5 THEN 'https://github.com/acme/tool?x=1' WHEN 6 THEN 'https://github.com/acme/tool#top' WHEN 7 THEN 'https://github.com/acme' WHEN 8 THEN 'https://github.com/acme/tool/tree' WHEN 9 THEN 'https://example.com/acme/tool' WHEN 10 THEN 'https://github.com/-acme/tool' WHEN 11 THEN 'https://github.com/acme/tool.' ELSE 'plain' END""",
    rid="CASE event_id % 7 WHEN 0 THEN 'github:acme/tool' WHEN 1 THEN 'github:Acme/tool' WHEN 2 THEN 'github:acme' WHEN 3 THEN 'gitlab:acme/tool' WHEN 4 THEN 'github:acme/tool-' || CAST(user_id AS STRING) WHEN 5 THEN 'github:/tool' ELSE 'github:a/b/c' END",
    stamp=f"CASE event_id % 5 WHEN 0 THEN {_T} WHEN 1 THEN CAST(ts AS STRING) WHEN 2 THEN '2024-02-30T10:00:00.000Z' WHEN 3 THEN '2024-01-01T25:00:00.000Z' ELSE '2024-02-29T23:59:59.999Z' END",
    code="CASE event_id % 8 WHEN 0 THEN 'not_found' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'aborted' WHEN 3 THEN 'network' WHEN 4 THEN 'server_error' WHEN 5 THEN 'invalid_response' WHEN 6 THEN 'invalid_path' END",
    diagnostic="CASE event_id % 8 WHEN 0 THEN 'TS_SYNTAX' WHEN 1 THEN 'parse_error' WHEN 2 THEN 'MODULE_UNRESOLVED' WHEN 3 THEN 'IMPORT_AMBIGUOUS' WHEN 4 THEN 'SOURCE_FILE_UNSUPPORTED' WHEN 5 THEN 'UNSUPPORTED_SYNTAX' WHEN 6 THEN 'GRAPH_TRUNCATED' ELSE 'FILE_TYPE' END",
)

_T1 = "lower(p_type)"
_NAME = "upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '')"

#: Source files of a few lines, some of which look like what the scans take and aren't.
CODE = Records(
    "part",
    path=f"'src/' || {_P} || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' ELSE '.ts' END",
    content=f"""CASE p_size % 4 WHEN 0 THEN 'import x from ''@' || {_T1} || '/core/x''; import y from "' || {_T1} || '"' WHEN 1 THEN 'import y from ''./' || {_T1} || '''' WHEN 2 THEN 'const z = require( "lib-' || {_T1} || '/sub")' ELSE 'imported from x' END || chr(10)
    || CASE p_partkey % 6 WHEN 0 THEN 'export class ' || {_NAME} || ' {{' WHEN 1 THEN 'let $b = 2' WHEN 2 THEN '  export async function run' || {_P} || '(' WHEN 3 THEN 'outlet y = class' WHEN 4 THEN 'interface ' || {_NAME} || ' extends type' ELSE 'constant x' END || chr(10)
    || CASE p_size % 3 WHEN 0 THEN 'app.get(''/' || {_T1} || '/' || {_P} || ''', f)' WHEN 1 THEN 'ROUTER.Post ( `/x/' || {_P} || '`' ELSE 'app.use(''/y'')' END || chr(10)
    || CASE p_partkey % 7 WHEN 0 THEN 'password = "abcdefgh"' WHEN 1 THEN 'token: ''short''' WHEN 2 THEN 'api-key: "abcdefghij" // example' WHEN 3 THEN 'secret = process.env.X' WHEN 4 THEN 'eval (x) + new Function(y); Token="0123456789"' WHEN 5 THEN 'evaluate(x); new  Function(y)' ELSE 'a test line' END || chr(10)
    || CASE p_size % 5 WHEN 0 THEN '// note: ' || p_brand WHEN 1 THEN '# NOTE: no' WHEN 2 THEN 'x // HACK:  cut' || chr(13) WHEN 3 THEN 'y //TODO:' || {_P} || ' ' ELSE '-- TODO: y' END""",
)

#: Documents, schemas and code whose texts hold knowledge.
KNOWLEDGE = Records(
    "part",
    path=f"CASE p_partkey % 3 WHEN 0 THEN 'docs/' || {_P} || '.md' WHEN 1 THEN 'db/' || {_P} || '.sql' ELSE 'src/' || {_P} || '.ts' END",
    content=f"""CASE p_partkey % 3 WHEN 0 THEN '# ' || p_name || chr(10) || '#### deep' || chr(10) || '##' || p_type || chr(10) || '### ' || p_brand || ' ' || chr(10) || '## crlf' || chr(13) || chr(10) || ' # indented' || chr(10) || '// ADR: ' || p_name
    WHEN 1 THEN '-- first' || chr(10) || 'CREATE TABLE IF NOT EXISTS `t_' || {_P} || '` (id INT, "price" DECIMAL(10,2),' || chr(10) || ' PRIMARY KEY (id));' || chr(10) || 'create table ' || {_T1} || chr(10) || '(a int, unique (a), b' || CAST(p_size AS STRING) || ' text );' || CASE WHEN p_size % 2 = 0 THEN ' CREATE TABLE ' || {_T1} || ' (again int);' ELSE 'create view v (x)' END
    ELSE 'let a = 1 // why: ' || p_name || ' and so on for a long while' || chr(10) || '// TODO: ' || p_brand || chr(10) || '// NOTE :no' END""",
)

#: Blobs as a provider sends them.
BLOBS = Records(
    "part",
    p_partkey="p_partkey",
    encoding="CASE p_size % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'base64' ELSE CASE WHEN p_size % 2 = 0 THEN 'base64' ELSE 'latin' END END",
    content="CASE p_partkey % 6 WHEN 0 THEN 'aGVsbG8=' WHEN 1 THEN 'aGVs' || chr(10) || 'bG8 =' WHEN 2 THEN 'aGVsbG8' WHEN 3 THEN 'aG=sbG8=' WHEN 4 THEN 'AAECAwQFBgc=' ELSE '' END",
)

#: Edges of order lines, of which many break a rule.
LINES = Records(
    "lineitem",
    edge_id=f"'edge:' || {_KEY}",
    src="'route:order/' || CAST(l_orderkey AS STRING)",
    dst="'file:part/' || CAST(l_partkey AS STRING)",
    kind=f"CASE {_L} WHEN 1 THEN 'imports' WHEN 2 THEN 'requires' WHEN 3 THEN 'exports' WHEN 4 THEN 'tests' ELSE 'references' END",
    provenance="CASE WHEN l_partkey % 31 = 0 THEN 'GUESSED' WHEN l_returnflag = 'A' THEN 'AMBIGUOUS' WHEN l_returnflag = 'R' THEN 'INFERRED' ELSE 'EXTRACTED' END",
    confidence="CASE WHEN l_orderkey % 13 = 0 THEN 1.5 WHEN l_tax > 0.02 THEN 1.0 - l_discount END",
    evidence=f"{_L} - 1",
    resolution=f"CASE WHEN {_L} IN (1, 2, 4) THEN CASE l_suppkey % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'resolved' WHEN 3 THEN 'external' END END",
    mode="CASE l_suppkey % 6 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'require' WHEN 3 THEN 'eager' ELSE 'type' END",
    specifier="CASE WHEN l_orderkey % 7 = 0 THEN ' lead' WHEN l_orderkey % 7 = 1 THEN '' WHEN l_orderkey % 7 = 2 THEN 'a' || chr(9) || 'b' ELSE './x/' || CAST(l_partkey AS STRING) END",
    type_only="l_partkey % 2 = 0",
    options="CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a.ts' WHEN 2 THEN 'b.ts,a.ts' ELSE 'a.ts,b.ts,a.ts' END",
    path=f"CASE WHEN l_orderkey % 9 = 0 THEN 'a/./b' ELSE 'src/' || {_KEY} END",
    start_line=f"CASE WHEN l_partkey % 5 <> 0 THEN {_L} - 1 END",
    start_column="CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 9 END",
    end_line=f"CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 6 END",
    end_column="CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey % 9 END",
    found="substr(CAST(l_shipdate AS STRING), 1, 10)",
)

#: Results with their snapshot, repository and graph, metrics and coverage, by supplier.
RESULTS = Records(
    "supplier",
    s_suppkey="s_suppkey",
    schema_version="CASE WHEN s_suppkey % 9 = 0 THEN '2.0' ELSE '1.0' END",
    job_id="CASE WHEN s_suppkey % 11 = 0 THEN ' job' ELSE 'job_' || CAST(s_suppkey AS STRING) END",
    analyzer="CASE WHEN s_suppkey % 12 = 0 THEN '' ELSE '1' END",
    provider="CASE WHEN s_suppkey % 13 = 0 THEN 'gitlab' ELSE 'github' END",
    repository_id="CASE WHEN s_suppkey % 7 = 0 THEN 'github:A/b' ELSE 'github:a/r' || CAST(s_suppkey % 5 AS STRING) END",
    snapshot_repository_id="'github:a/r' || CAST(s_suppkey % 4 AS STRING)",
    snapshot="'snap_' || CAST(s_suppkey AS STRING)",
    graph_snapshot="CASE s_suppkey % 3 WHEN 0 THEN 'snap_' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'snap_other' END",
    coverage="s_suppkey % 2",
    snapshot_coverage="s_suppkey % 4",
    commit_sha="sha1(CAST(s_nationkey AS STRING))",
    tree_sha="sha1(s_name)",
    requested_ref="CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE 'dev' END",
    total_files="s_suppkey % 8",
    analyzed_files="s_suppkey % 9",
    percentage="CASE WHEN s_suppkey % 8 = 0 THEN 1.0 WHEN s_suppkey % 5 = 0 THEN 1.25 ELSE CAST(s_suppkey % 9 AS DOUBLE) / CAST(s_suppkey % 8 AS DOUBLE) END",
    node_count="s_suppkey % 6",
    nodes="s_suppkey % 5",
    edge_count="s_suppkey % 3",
    edges="s_suppkey % 4",
    discovered="s_suppkey % 8",
    analyzed="s_suppkey % 7",
    skipped="s_suppkey % 3",
    bytes="s_suppkey % 50",
    analyzed_bytes="s_suppkey % 60",
)


def texts_of(forms: tuple[str, ...], key: str = "event_id") -> str:
    """SQL of one text a row, the forms in turn.  NUMBER in a form stands for the key; back slashes and quotes are
    written so that Spark and the SQL checks read the same."""
    def quoted(form: str) -> str:
        parts = form.replace("'", "''").split("\\")
        return "'" + "' || chr(92) || '".join(parts).replace("NUMBER", f"' || CAST({key} AS STRING) || '") + "'"

    cases = " ".join(f"WHEN {i} THEN {quoted(f)}" for i, f in enumerate(forms))
    return f"CASE {key} % {len(forms)} {cases} END"


#: Graph queries as clients send them: nested and repeated names, numbers in quotes, fractions, nulls, lists out of
#: order, escapes, blanks of all kinds, and text that isn't JSON.
QUERY_FORMS = (
    '{"type":"search","text":"aNUMBER"}',
    '{"type":"search","text":5,"x":{"text":"y"}}',
    '{"type":"node","nodeId":7,"budget":{"nodeId":"z"}}',
    '{"type":"search","text":""}',
    '{"type":"search","text":" a","cursor":-1}',
    '{"type":"search","text":"a\u00a0","cursor":5.0}',
    '{"type":"search","text":"' + "x" * 256 + '","cursor":50000}',
    '{"type":"search","text":"' + "x" * 257 + '","cursor":50001}',
    '{"type":"search","text":"' + "😀" * 128 + '"}',
    '{"type":"search","text":"' + "😀" * 129 + '"}',
    '{"type":"search","text":"a\tb"}',
    '{"type":"search","text":"a","kinds":["symbol","file","symbol"],"cursor":1e2}',
    '{"type":"search","text":"a","kinds":[]}',
    '{"type":"search","text":"a","kinds":["edge"],"cursor":"1"}',
    '{"type":"search","text":"a","kinds":["file",5]}',
    '{"type":"search","text":"a","kinds":"file"}',
    '{"type":"search","text":"a","kinds":null,"cursor":null}',
    '{"kinds":["package"],"text":"a b","cursor":0,"budget":{"maxTimeMs":1},"type":"search"}',
    '{"type":"node","nodeId":"nNUMBER"}',
    '{"type":"node"}',
    '{"type":"node","nodeId":null}',
    '{"type":"node","nodeId":"n","cursor":0}',
    '{"type":"node","nodeId":"n","budget":{"maxRows":1}}',
    '{"type":"node","nodeId":"n","budget":{"maxResults":501}}',
    '{"type":"node","nodeId":"n","budget":{"maxResults":500,"maxCost":1,"maxTimeMs":2000}}',
    '{"type":"node","nodeId":"n","budget":null}',
    '{"type":"node","nodeId":"n","budget":[1]}',
    '{"type":"node","nodeId":"n","budget":{"maxCost":"5"}}',
    '{"type":"explain","nodeId":"n","budget":{}}',
    '{"type":"explain","nodeId":"n","direction":"both"}',
    '{"type":"neighbors","nodeId":"n","direction":"up"}',
    '{"type":"neighbors","nodeId":"n","direction":null}',
    '{"type":"neighbors","nodeId":"n","edgeKinds":["tests","calls","tests"],"budget":{"maxCost":50000}}',
    '{"type":"neighbors","nodeId":"n","edgeKinds":["exports"],"cursor":0.5}',
    '{"type":"impact","nodeId":"n","maxDepth":20,"direction":"incoming"}',
    '{"type":"impact","nodeId":"n","maxDepth":21}',
    '{"type":"impact","nodeId":"n","maxDepth":0,"budget":{"maxCost":0}}',
    '{"type":"impact","nodeId":"n","maxDepth":true}',
    '{"type":"shortestPath","from":"a","to":"b"}',
    '{"type":"shortestPath","from":"a","to":{"to":"b"}}',
    '{"type":"shortestPath","from":"a"}',
    '{"type":"walk"}',
    '{"type":["node"],"nodeId":"n"}',
    '{"text":"a"}',
    '[{"type":"node","nodeId":"n"}]',
    '"node"',
    "null",
    "not json",
    '{"type":"node","nodeId":"n"',
    "",
    '{"type":"explain","nodeId":"it\u0027s"}',
)
QUERIES = Records("events", event_id="event_id", body=texts_of(QUERY_FORMS))

#: Requests for jobs, of the service to the store, results that come back and messages, well formed and not.
REQUEST_FORMS = {
    "create": (
        '{"repositoryUrl":"https://github.com/acme/tool-NUMBER"}',
        '{"ref":"main","repositoryUrl":"https://github.com/Acme/Tool.git"}',
        '{"repositoryUrl":"HTTPS://GitHub.com:443/acme/tool?"}',
        '{"repositoryUrl":"http://github.com/acme/tool"}',
        '{"repositoryUrl":"https://u@github.com/acme/tool"}',
        '{"repositoryUrl":"https://github.com/acme/tool?x=1","ref":""}',
        '{"repositoryUrl":"https://github.com/acme/tool/tree","ref":null}',
        '{"repositoryUrl":"https://github.com/-acme/tool","branch":"x"}',
        '{"repositoryUrl":" https://github.com/acme/tool"}',
        '{"repositoryUrl":{"repositoryUrl":"https://github.com/acme/tool"}}',
        '{"x":{"repositoryUrl":"https://github.com/acme/tool"}}',
        "[]",
    ),
    "input": (
        '{"analyzerVersion":"1","idempotencyKey":"kNUMBER","repositoryId":"github:acme/tool","requestedRef":"main"}',
        '{"analyzerVersion":"1","idempotencyKey":"k","repositoryId":"github:Acme/tool","requestedRef":"main"}',
        '{"analyzerVersion":1,"idempotencyKey":"k","repositoryId":"github:acme/tool","requestedRef":"main"}',
        '{"analyzerVersion":"1","idempotencyKey":" k","repositoryId":null,"requestedRef":"main"}',
        '{"analyzerVersion":"1","idempotencyKey":"k","repositoryId":"github:acme/tool","nested":{"requestedRef":"main"}}',
    ),
    "response": (
        '{"jobId":"job_NUMBER","status":"succeeded","result":{"graph":{}}}',
        '{"jobId":"job_1","status":"failed","result":{}}',
        '{"jobId":"","status":"succeeded","result":[]}',
        '{"jobId":"job_1","status":"succeeded","result":null,"error":{}}',
        '{"result":{"jobId":"job_1","status":"succeeded"}}',
    ),
    "message": (
        '{"schemaVersion":"1.0","jobId":"job_NUMBER","expectedStage":"inventory"}',
        '{"schemaVersion":"1.0","jobId":"job_NUMBER","expectedStage":"fetch-content","cursor":"10"}',
        '{"schemaVersion":"1.0","jobId":"","expectedStage":"inventory"}',
        '{"schemaVersion":"2.0","jobId":"j","expectedStage":"inventory"}',
        '{"schemaVersion":1.0,"jobId":"j","expectedStage":"inventory"}',
        '{"schemaVersion":"1.0","jobId":"j","expectedStage":"complete"}',
        '{"schemaVersion":"1.0","jobId":"j","expectedStage":"analyze","cursor":""}',
        '{"schemaVersion":"1.0","jobId":"j","expectedStage":"analyze","cursor":10}',
        '{"schemaVersion":"1.0","jobId":"j","body":{"expectedStage":"analyze"}}',
        '{"schemaVersion":"1.0","jobId":"job_NUMBER","expectedStage":"analyze"}',
        "not json",
    ),
}
REQUESTS = {kind: Records("events", event_id="event_id", body=texts_of(forms)) for kind, forms in REQUEST_FORMS.items()}

#: JSON of any nesting, keys in any order.
DOCUMENT_FORMS = (
    '{"b":[{"z":NUMBER,"a":null}],"a":true}',
    '{ "k" : { "y" : { "d" : [ ] , "c" : { } } , "x" : "it\u0027s" } , "e" : -5 }',
    '[{"b":1,"a":[{"d":0,"c":[{"f":1,"e":2}]}]},"t",false]',
    '{"key two":"NUMBER","Key":"A","key":"a","_":"\u00e9"}',
    '"text"',
    '{"open":[1,2}',
    "plain",
)
DOCUMENTS = Records("events", event_id="event_id", body=texts_of(DOCUMENT_FORMS))

#: Deliveries of jobs' messages in their order, with what their handling ran into.
MESSAGES = Records(
    "events",
    job_id="'job_' || CAST(user_id AS STRING)",
    place="event_id",
    stage="CASE event_id % 4 WHEN 0 THEN 'inventory' WHEN 3 THEN 'analyze' ELSE 'fetch-content' END",
    cursor="CASE WHEN event_id % 4 IN (1, 2) AND event_id % 5 = 0 THEN CAST((event_id % 3) * 10 AS STRING) END",
    total="user_id % 35",
    fails="CASE WHEN event_id % 13 = 0 THEN 'again' WHEN event_id % 397 = 1 THEN 'analysis_failed' END",
)

#: What imports name, from files of brands' directories.
SPECIFIERS = Records(
    "part",
    importer=f"p_brand || '/src/' || {_P} || '.ts'",
    specifier=f"CASE p_partkey % 8 WHEN 0 THEN './' || CAST(p_size AS STRING) WHEN 1 THEN '../lib/' || CAST(p_size AS STRING) || '.js' WHEN 2 THEN '@ws/' || {_T1} WHEN 3 THEN '@ws/' || {_T1} || '/none' WHEN 4 THEN '~/' || CAST(p_size AS STRING) WHEN 5 THEN 'lib/' || CAST(p_size AS STRING) WHEN 6 THEN '../../../out' ELSE 'ext-' || {_T1} || '/sub' END",
)

#: Paths of pages, handlers and other files of an application's folders; NUMBER stands for the part's key.
ROUTE_FORMS = (
    "app/page.tsx",
    "app/route.ts",
    "src/app/(site)/@main/shop/NUMBER/page.tsx",
    "App/Shop/Page.TSX",
    "app/a/route.mts",
    "app/a/ROUTE.CTS",
    "app/b/index/page.jsx",
    "app/index/route.cjs",
    "app/(a)/(b)/page.mjs",
    "app/()/@/page.js",
    "web/app/x/app/y/page.ts",
    "app/docs/[...slug]/page.tsx",
    "app/api/users/[id]/route.ts",
    "pages/api/users/index.ts",
    "src/pages/api/NUMBER.ts",
    "pages/api/index.js",
    "Pages/API/Deep/x.MTS",
    "pages/api/a.b.test.ts",
    "pages/about.tsx",
    "pages/api/readme.md",
    "myapp/page.tsx",
    "app/page.tsx.bak",
    "app/pages/api/v1/page.ts",
    "app/layout.tsx",
    "application/route.ts",
)
ROUTE_FILES = Records("part", p_partkey="p_partkey", path=texts_of(ROUTE_FORMS, "p_partkey"))

#: Diagnostics of the repositories that FILES has; some have no syntax errors, some no unresolved imports.
REPOSITORY_DIAGNOSTICS = Records(
    "events",
    repo="'Brand#' || CAST(1 + user_id % 5 AS STRING) || CAST(1 + CAST((user_id % 25 - user_id % 5) / 5 AS INT) AS STRING)",
    code="CASE WHEN user_id % 5 < 2 AND event_id % 9 = 0 THEN 'TS_PARSE_ERROR' WHEN user_id % 25 > 14 AND event_id % 4 = 1 THEN 'MODULE_UNRESOLVED' WHEN event_id % 5 = 2 THEN 'SOURCE_FILE_UNSUPPORTED' ELSE 'GRAPH_TRUNCATED' END",
)

#: Nodes of a graph as JSON; the manifest holds every file src/NUMBER.ts of an even key.
NODE_FORMS = (
    '{"id":"nNUMBER","kind":"file","name":"a","metadata":{"path":"src/NUMBER.ts"}}',
    '{"id":"n","kind":"file","name":"a","metadata":{"path":"src/NUMBER.ts","language":"ts","sizeBytes":0,"module":"m"},"location":{"path":"src/NUMBER.ts","startLine":1}}',
    '{"id":"n","kind":"file","name":"a","metadata":{"path":"../x","sizeBytes":-1,"contentSha256":"AB"}}',
    '{"id":"n","kind":"file","name":"a","metadata":{"language":" ts","sizeBytes":1.5}}',
    '{"id":" n","kind":"symbol","name":"","metadata":{"symbolKind":"class","visibility":"open","exported":"yes"}}',
    '{"id":"n","kind":"symbol","name":"S","metadata":{"symbolKind":"class","visibility":"private","exported":true,"async":false,"signature":"()"}}',
    '{"id":"n","kind":"symbol","name":"S","metadata":{"kind":"class"}}',
    '{"id":"n","kind":"package","name":"p","metadata":{"packageName":"p","version":"1","workspacePath":"a/../b"}}',
    '{"id":"n","kind":"package","name":"p","metadata":{"packageName":"p","manager":5,"workspacePath":"lib/p"}}',
    '{"id":"n","kind":"route","name":"r","metadata":{"path":"/r","methods":["GET","POST"],"framework":"x"}}',
    '{"id":"n","kind":"route","name":"r","metadata":{"path":"/r ","methods":["GET",""]}}',
    '{"id":"n","kind":"route","name":"r","metadata":{"path":"/r","methods":"GET"}}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"table","fields":[]}}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"table","fields":[1]},"extra":1}',
    '{"id":"n","kind":"document","name":"d","metadata":{}}',
    '{"id":"n","kind":"schema","name":"s"}',
    '{"id":"n","kind":"schema","name":"s","metadata":[],"location":null}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"t"},"location":{"path":"src/NUMBER.ts","startColumn":2}}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"t"},"location":{"path":"src/NUMBER.ts","startLine":5,"endLine":4,"endColumn":1}}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"t"},"location":{"path":"src/NUMBER.ts","startLine":5,"startColumn":9,"endLine":5,"endColumn":8}}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"t"},"location":{"startLine":0,"file":"x"}}',
    '{"id":"n","kind":"schema","name":"s","metadata":{"schemaKind":"t"},"location":{"path":"/abs","startLine":"1"}}',
    "[]",
    "no json",
)
NODE_TEXTS = Records("part", p_partkey="p_partkey", body=texts_of(NODE_FORMS, "p_partkey"))
NODE_MANIFEST = "SELECT 'src/' || CAST(p_partkey AS STRING) || '.ts' AS path FROM part WHERE p_partkey % 2 = 0"
