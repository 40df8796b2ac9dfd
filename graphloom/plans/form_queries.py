"""Queries of canonical form, documents, stored artifacts, module resolution and job replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import canonical as K
from graphloom.operators import export as O
from graphloom.operators import extract as E
from graphloom.operators import repository as P
from graphloom.operators import resolve as M
from graphloom.plans.graph_queries import FILES
from graphloom.sources.fixture import SQL as FX
from graphloom.plans.registry import query
from graphloom.sources import artifacts as A
from graphloom.sources import local as L
from graphloom.sources.fixture import edges, nodes, table
from graphloom.sources.records import CODE, ENTRIES, LINES, MESSAGES, SPECIFIERS
from graphloom.sources.records import FILES as FILE_LIST
from graphloom.sources.shared import shared_folder
from graphloom.streaming import jobs as J
from graphloom.streaming import stateful as ST


def line_edges(spark, d):
    """The order lines' edges with their evidence and, where they are imports, what they import."""
    candidates = F.filter(F.split("options", ","), lambda x: x != "")
    return LINES.read(spark, d).select(F.col("edge_id").alias("id"), F.concat("src", F.lit("/x")).alias("src"), F.concat(F.lit("d"), F.substring("dst", -1, 1)).alias("dst"), "kind", "provenance", F.round("confidence", 2).alias("confidence"), F.array("found").alias("evidence"), "mode", F.trim("specifier").alias("specifier"), "type_only", "resolution", candidates.alias("candidates"))


EDGES = f"""r AS (SELECT edge_id AS id, src || '/x' AS src, 'd' || right(dst, 1) AS dst, kind, provenance, round(confidence, 2) AS confidence, found, mode, trim(specifier) AS specifier, type_only, resolution, list_sort(list_distinct(list_filter(string_split(options, ','), lambda x: x <> ''))) AS cands FROM ({LINES.sql})),
m AS (SELECT *, CASE WHEN resolution IS NOT NULL THEN '{{"candidates":' || CASE WHEN len(cands) = 0 THEN '[]' ELSE '["' || array_to_string(cands, '","') || '"]' END || ',"mode":"' || mode || '","resolution":"' || resolution || '","specifier":' || to_json(specifier) || ',"typeOnly":' || type_only || '}}' END AS meta FROM r),
c AS (SELECT min(id) AS id, src, dst, kind, provenance, confidence, meta, '["' || string_agg(DISTINCT found, '","' ORDER BY found) || '"]' AS evidence FROM m GROUP BY src, dst, kind, provenance, confidence, meta),
ce AS (SELECT id, src, dst, kind, '{{' || CASE WHEN confidence IS NOT NULL THEN '"confidence":' || regexp_replace(confidence::VARCHAR, '\\.0$', '') || ',' ELSE '' END || '"evidence":' || evidence || ',"from":"' || src || '","id":"' || id || '","kind":"' || kind || '",' || CASE WHEN meta IS NOT NULL THEN '"metadata":' || meta || ',' ELSE '' END || '"provenance":"' || provenance || '","to":"' || dst || '"}}' AS json FROM c)"""


@query("canonical_edges", f"WITH {EDGES} SELECT id, src, dst, kind, json FROM ce")
def canonical_edges(spark, d):
    return K.canonical_edges(line_edges(spark, d))


NODES = """cn AS (SELECT id, '{"id":"' || id || '","kind":"' || kind || '",' || CASE WHEN path IS NOT NULL THEN '"location":{"path":"' || path || '"},' ELSE '' END || '"metadata":{' || concat_ws(',', CASE WHEN exported IS NOT NULL THEN '"exported":' || exported END, CASE WHEN method IS NOT NULL THEN '"methods":["' || method || '"]' END, CASE WHEN symbol_kind IS NOT NULL THEN '"symbolKind":"' || symbol_kind || '"' END) || '},"name":"' || name || '"}' AS json FROM fx_nodes)"""


@query("canonical_nodes", FX + f", {NODES} SELECT id, json FROM cn")
def canonical_nodes(spark, d):
    return K.canonical_nodes(nodes(spark, d))


@query("assembled_graph", FX + f""", {NODES}, {EDGES},
f AS (SELECT 'nodes' AS what, json FROM cn UNION ALL SELECT 'edges', json FROM ce),
v AS (SELECT 'before' AS w, 2 AS times, src, dst, kind FROM m UNION ALL SELECT 'after', 1, src, dst, kind FROM ce)
SELECT what, count(*) AS n, sum(('0x' || md5(json)[1:6])::BIGINT)::BIGINT AS total, bit_xor(('0x' || md5(json)[7:14])::BIGINT) AS mixed FROM f GROUP BY what
UNION ALL SELECT 'before duplicate-id', count(*), NULL, NULL FROM fx_nodes
UNION ALL SELECT w || ' src', sum(times)::BIGINT, NULL, NULL FROM v WHERE src NOT IN (SELECT id FROM fx_nodes) GROUP BY w
UNION ALL SELECT w || ' dst', sum(times)::BIGINT, NULL, NULL FROM v WHERE dst NOT IN (SELECT id FROM fx_nodes) GROUP BY w""")
def assembled_graph(spark, d):
    """A graph put together from every row twice, in another order: what was broken before and after, and fingerprints of
    the canonical form, which are those of the rows taken once."""
    n, e = nodes(spark, d), line_edges(spark, d)
    twice = lambda df: df.unionByName(df.repartition(7, F.rand(3)))
    return K.assemble(twice(n), twice(e))[-1]


@query("surviving_ids", f"WITH {EDGES} SELECT m.id AS old, c.id AS id FROM m JOIN c ON m.src = c.src AND m.dst = c.dst AND m.kind = c.kind AND m.provenance = c.provenance AND m.confidence IS NOT DISTINCT FROM c.confidence AND m.meta IS NOT DISTINCT FROM c.meta")
def surviving_ids(spark, d):
    return K.surviving_ids(line_edges(spark, d))


DIAGNOSTICS = "di AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS code, 'warning' AS severity, CASE WHEN l_linenumber > 5 THEN 'edge:none' ELSE 'edge:' || l_orderkey || '-' || l_linenumber END AS edge_id FROM lineitem)"


def diagnostics(spark, d):
    l, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    edge = F.when(n > 5, "edge:none").otherwise(F.concat(F.lit("edge:"), F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string")))
    return l.select(F.when(n % 2 == 0, "A").otherwise("B").alias("code"), F.lit("warning").alias("severity"), edge.alias("edge_id"))


MAPPED = f"""WITH {EDGES}, si AS (SELECT m.id AS old, c.id AS id FROM m JOIN c ON m.src = c.src AND m.dst = c.dst AND m.kind = c.kind AND m.provenance = c.provenance AND m.confidence IS NOT DISTINCT FROM c.confidence AND m.meta IS NOT DISTINCT FROM c.meta), {DIAGNOSTICS},
dm AS (SELECT DISTINCT code, severity, coalesce(id, edge_id) AS edge_id FROM di LEFT JOIN si ON old = edge_id)"""


@query("remap_diagnostics", MAPPED + " SELECT code, severity, edge_id FROM dm")
def remap_diagnostics(spark, d):
    """Diagnostics of merged edges point to the edge that stays."""
    return K.remap_diagnostics(diagnostics(spark, d), K.surviving_ids(line_edges(spark, d)))


@query("graph_metrics", MAPPED.replace("WITH ", FX + ", ", 1) + " SELECT (SELECT count(*) FROM fx_nodes) AS node_count, (SELECT count(*) FROM ce) AS edge_count, (SELECT count(*) FROM dm) AS diagnostic_count")
def graph_metrics(spark, d):
    e = line_edges(spark, d)
    return K.metrics(nodes(spark, d), K.canonical_edges(e), K.remap_diagnostics(diagnostics(spark, d), K.surviving_ids(e)))


@query("manifest_order", "SELECT l_suppkey AS snapshot, l_orderkey || '-' || l_linenumber AS path, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey || '-' || l_linenumber, l_partkey) - 1)::INTEGER AS place FROM lineitem")
def manifest_order(spark, d):
    """Entries of each snapshot by path; their number has a bound."""
    from pyspark.sql import Window

    l = table(spark, d, "lineitem")
    path = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    rows = l.select(F.col("l_suppkey").alias("snapshot"), path.alias("path"), "l_partkey")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("snapshot").orderBy("path", "l_partkey")) - 1).drop("l_partkey")


@query("unique_by", "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1")
def unique_by(spark, d):
    return K.unique_by(table(spark, d, "events").select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], ["value", "event_id"])


@query("graph_caps", FX + """, n AS (SELECT * FROM fx_nodes ORDER BY id || '"' LIMIT 5000), e AS (SELECT * FROM fx_edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY src, dst, kind LIMIT 2000)
SELECT 'node' AS what, kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'GRAPH_TRUNCATED', 'warning', 1 WHERE (SELECT count(*) FROM fx_nodes) > 5000 OR (SELECT count(*) FROM fx_edges) > 2000""")
def graph_caps(spark, d):
    """A graph cut to 5,000 nodes and 2,000 edges, and the diagnostic that says so."""
    n, e, said = K.capped(nodes(spark, d), edges(spark, d), 5_000, 2_000)
    count = lambda df, what: df.groupBy(what.alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return count(n, F.lit("node")).unionByName(count(e, F.lit("edge"))).unionByName(count(said.withColumn("kind", F.col("severity")), F.col("code")))


JSON = FX + f""", {NODES}, fe2 AS (SELECT '{{"from":"' || src || '","kind":"' || kind || '","to":"' || dst || '"}}' AS json FROM fx_edges),
doc AS (SELECT 0 AS section, '00000000' AS place, '{{"nodes":[' AS line UNION ALL SELECT 1, json, json || CASE WHEN json = (SELECT max(json) FROM cn) THEN '' ELSE ',' END FROM cn UNION ALL SELECT 2, '00000000', '],"edges":['
UNION ALL SELECT 3, json, json || CASE WHEN json = (SELECT max(json) FROM fe2) THEN '' ELSE ',' END FROM fe2 UNION ALL SELECT 4, '00000000', ']}}')"""


@query("json_document", JSON + " SELECT section, place, line FROM doc")
def json_document(spark, d):
    return O.json_document(nodes(spark, d), edges(spark, d))


@query("html_document", JSON + """, s AS (SELECT id, name, kind, path FROM fx_nodes ORDER BY id LIMIT 100), k AS (SELECT count(*) AS n, count(*) FILTER (kind = 'file') AS f, count(*) FILTER (kind = 'symbol') AS y, (SELECT count(*) FROM fx_edges) AS e FROM fx_nodes)
SELECT 0 AS section, '00000000' AS place, '<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>a/&lt;b&gt;</title></head><body>' AS line UNION ALL SELECT 0, '00000001', '<h1>a/&lt;b&gt;</h1><p><strong>Commit:</strong> <code>c0</code></p>'
UNION ALL SELECT 1, '0', '<p><strong>Files:</strong> ' || f || ' | <strong>Symbols:</strong> ' || y || ' | <strong>Edges:</strong> ' || e || '</p><h2>Nodes (' || n || ')</h2>' FROM k
UNION ALL SELECT 2, '00000000', '<table><thead><tr><th>Name</th><th>Kind</th><th>Location</th></tr></thead><tbody>' UNION ALL SELECT 3, id, '<tr><td><code>' || replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</code></td><td><span class="badge">' || kind || '</span></td><td>' || coalesce(path, '-') || '</td></tr>' FROM s
UNION ALL SELECT 4, '00000000', '</tbody></table><script type="application/json" id="graph-data">' UNION ALL SELECT section + 5, place, line FROM doc UNION ALL SELECT 9, '00000000', '</script></body></html>'""")
def html_document(spark, d):
    return O.html_document(nodes(spark, d), edges(spark, d), "a/<b>", "c0")


@query("report_document", FILES + """, f AS (SELECT from_path AS path, 0 AS i, 1 AS o FROM fe UNION ALL SELECT to_path, 1, 0 FROM fe), h AS (SELECT path, sum(i) AS i, sum(o) AS o, sum(i) + sum(o) AS t FROM f GROUP BY path ORDER BY t DESC, path LIMIT 10),
m AS (SELECT 0 AS place, '- **Files:** ' || count(*) FILTER (kind = 'file') AS line FROM fx_nodes UNION ALL SELECT 1, '- **Symbols:** ' || count(*) FILTER (kind = 'symbol') FROM fx_nodes
UNION ALL SELECT 2, '- **Routes:** ' || count(*) FILTER (kind = 'route') FROM fx_nodes UNION ALL SELECT 3, '- **Packages:** ' || count(*) FILTER (kind = 'package') FROM fx_nodes UNION ALL SELECT 4, '- **Total Edges:** ' || count(*) FROM fx_edges),
x AS (SELECT unnest([0, 0, 0, 0, 0, 1, 3, 5, 5, 7, 7, 7]) AS section, unnest([0, 1, 2, 3, 4, 0, 0, 0, 1, 0, 1, 2]) AS place, unnest(['# Code Graph Analysis Report', '**Repository:** `a/b`', '**Commit:** `c0`', '**Schema:** `v2.0`', '**Health Score:** `70/100` (9 analyzed, 1 skipped)', '## Summary Metrics', '## Hub Modules', '## Dependency Architecture', '```mermaid', '```', '---', '*Generated by graphloom*']) AS line
UNION ALL SELECT 2, place, line FROM m UNION ALL SELECT 4, row_number() OVER (ORDER BY t DESC, path) - 1, '- `' || path || '` (' || t || ' connections: ' || i || ' in / ' || o || ' out)' FROM h)
SELECT section::INTEGER AS section, printf('%08d', place) AS place, line FROM x""")
def report_document(spark, d):
    """A report without its diagram, which mermaid_lines checks."""
    return O.report_document(nodes(spark, d), edges(spark, d), "a/b", "c0", 70, 9, 1).filter("section <> 6")


@query("export_formats", "SELECT unnest(['mermaid', 'report', 'html', 'json', 'odd']) AS format, unnest(['text/plain; charset=utf-8', 'text/markdown; charset=utf-8', 'text/html; charset=utf-8', 'application/json; charset=utf-8', 'application/json; charset=utf-8']) AS content_type, unnest(['analysis-a1-graph.mmd', 'analysis-a1-GRAPH_REPORT.md', 'analysis-a1-graph.html', 'analysis-a1-graph.json', 'analysis-a1-graph.json']) AS file, true AS has_lines FROM region WHERE r_regionkey = 0")
def export_formats(spark, d):
    """Every export format by name, each with the document that it gives; an unknown one gives JSON."""
    n, e = nodes(spark, d), edges(spark, d)
    out = None
    for name in ("mermaid", "report", "html", "json", "odd"):
        document, content, file = O.export(n, e, name, "a1", repository="a/b", commit="c0", **({"score": 1, "analyzed": 1, "skipped": 0} if name == "report" else {}))
        part = document.agg((F.count(F.lit(1)) > 2).alias("has_lines")).select(F.lit(name).alias("format"), F.lit(content).alias("content_type"), F.lit(file).alias("file"), "has_lines")
        out = part if out is None else out.unionByName(part)
    return out


# --- stored artifacts ------------------------------------------------------------------------

PUT = """w AS (SELECT doc_id, 'blob/' || source || '/' || (n_chars // 50) AS key, sha256(coalesce(text, '')) AS h FROM documents), f AS (SELECT key, min(doc_id) AS first_id, arg_min(h, doc_id) AS fh FROM w GROUP BY key)"""


@query("artifact_readback", f"WITH {PUT} SELECT key, fh AS hash, true AS intact FROM f WHERE key IS NOT NULL")
def artifact_readback(spark, d):
    """Documents put under shared keys into a table of artifacts and read back; conflicts leave the first."""
    docs = table(spark, d, "documents")
    key = A.artifact_key("blob", F.concat_ws("/", "source", F.floor(F.col("n_chars") / 50).cast("string")))
    store = A.ArtifactTable(spark, shared_folder(spark))
    writes = docs.filter("source IS NOT NULL AND n_chars IS NOT NULL").select("doc_id", key.alias("key"), "text")
    store.put(writes, "key", "doc_id", "text")
    return store.get(writes.select("key")).select("key", "hash", "intact")


@query("artifact_keys", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'manifest/s' || user_id || '/inventory.json' WHEN 1 THEN 'manifest/s' || user_id || '/inventory.json' WHEN 2 THEN 'manifest/s' || user_id || '/progress-' || event_id || '.json' END AS checkpoint, CASE event_id % 4 WHEN 0 THEN 'result/r' || user_id WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS result FROM events")
def artifact_keys(spark, d):
    """Keys of checkpoints and results; unsafe identities have none."""
    e, k, user = table(spark, d, "events"), F.col("event_id") % 4, F.col("user_id").cast("string")
    snapshot = F.when(k == 3, F.concat(F.lit("../s"), user)).otherwise(F.concat(F.lit("s"), user))
    cursor = F.when(k == 1, "0").when(k > 1, F.col("event_id").cast("string"))
    identity = F.when(k == 0, F.concat(F.lit("r"), user)).when(k == 1, "").when(k == 2, F.concat(F.lit("/r"), user)).otherwise("a/../b")
    return e.select("event_id", A.checkpoint_key(snapshot, cursor).alias("checkpoint"), A.artifact_key("result", identity).alias("result"))


@query("result_states", """SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 7 = 0 THEN 'not_ready' WHEN s_suppkey % 7 = 1 THEN 'unavailable' WHEN s_suppkey % 7 = 2 THEN 'missing' WHEN s_suppkey % 7 = 3 THEN 'damaged' WHEN s_suppkey % 7 = 4 THEN 'malformed' WHEN s_suppkey % 7 = 5 THEN 'other_job' ELSE 'ok' END AS state, CASE WHEN s_suppkey % 7 = 6 THEN s_name END AS name FROM supplier""")
def result_states(spark, d):
    """What reading each job's result comes to."""
    s = table(spark, d, "supplier")
    k, id_ = F.col("s_suppkey") % 7, F.col("s_suppkey").cast("string")
    body = F.when(k == 4, "{broken").otherwise(F.to_json(F.struct(F.when(k == 5, "0x").otherwise(id_).alias("jobId"), F.col("s_name").alias("name"))))
    stored = s.filter(k != 2).select(F.concat(F.lit("result/"), id_).alias("key"), body.alias("body"))
    index = s.select(id_.alias("job_id"), F.when(k == 0, "running").otherwise("succeeded").alias("status"), F.when(k != 1, F.concat(F.lit("result/"), id_)).alias("result_key"), F.when(k == 3, "0").otherwise(A.hash_of(body)).alias("result_hash"))
    return A.results(index, stored, "jobId string, name string").select(F.col("job_id").cast("long").alias("job_id"), "state", F.col("result.name").alias("name"))


@query("content_join", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'missing' WHEN p_partkey % 4 = 2 THEN 'damaged' ELSE 'ok' END AS state FROM part WHERE p_size % 3 <> 0")
def content_join(spark, d):
    """Eligible entries of a manifest with their stored content: intact, damaged or missing."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    entries = p.filter("p_size % 3 <> 0").select("p_partkey", F.concat(F.lit("blob/"), F.col("p_partkey").cast("string")).alias("key"), A.hash_of(F.col("p_name")).alias("wanted"))
    stored = p.filter(k != 1).select(F.concat(F.lit("blob/"), F.col("p_partkey").cast("string")).alias("key"), F.when(k == 2, "other").otherwise(F.col("p_name")).alias("body"))
    j = entries.join(stored, "key", "left")
    return j.select("p_partkey", F.when(F.col("body").isNull(), "missing").when(A.hash_of(F.col("body")) != F.col("wanted"), "damaged").otherwise("ok").alias("state"))


@query("provider_identity", "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 5 = 1 OR p_partkey % 7 = 6 THEN 'provider-identity-mismatch' WHEN p_partkey % 5 = 2 THEN 'binary-or-invalid-utf8' END AS reason FROM part")
def provider_identity(spark, d):
    """Blobs that came against those that were asked for: of another sha or size, binary, or none at all."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    sha, body = F.sha1(F.col("p_name")), F.when(k == 2, F.lit("\0x")).otherwise(F.col("p_name"))
    entries = p.select(F.col("p_partkey").cast("string").alias("path"), sha.alias("sha"), F.length(body).cast("long").alias("size"))
    came = p.filter("p_partkey % 7 <> 6").select(F.col("p_partkey").cast("string").alias("path"), F.when(k == 0, F.sha1(F.lit("x"))).otherwise(sha).alias("sha"), (F.length(body) + F.when(k == 1, 1).otherwise(0)).cast("long").alias("size"), body.cast("binary").alias("content"))
    return L.provider_identity(entries, came)


@query("tree_entries", """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'symlink' WHEN 2 THEN 'submodule' WHEN 4 THEN 'blob' WHEN 5 THEN NULL WHEN 6 THEN 'blob' ELSE 'blob' END AS kind, l_linenumber <> 5 AND l_linenumber <> 6 AND l_partkey % 9 <> 0 AS valid FROM lineitem WHERE l_linenumber <> 3""")
def tree_entries(spark, d):
    """Entries of a provider's tree: kinds by mode and type, with odd ones and unsafe paths."""
    n = F.col("l_linenumber")
    mode = F.when(n == 1, "120000").when(n == 2, "160000").when(n == 3, "040000").otherwise("100644")
    type_ = F.when(n == 2, "commit").when(n == 3, "tree").when(n == 5, "tag").otherwise("blob")
    path = F.concat(F.when(n == 6, "../").otherwise("a/"), F.col("l_orderkey").cast("string"))
    tree = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path"), mode.alias("mode"), type_.alias("type"), F.when(F.col("l_partkey") % 9 == 0, "x").otherwise(F.sha1(path)).alias("sha"))
    return L.tree_entries(tree).select("l_orderkey", "l_linenumber", "kind", "valid")


@query("joined_tree", """SELECT DISTINCT p_brand AS path, 'tree' AS type FROM part UNION ALL SELECT DISTINCT p_brand || '/' || p_type, 'tree' FROM part UNION ALL SELECT p_brand || '/' || p_type || '/' || p_partkey || '.js', 'blob' FROM part""")
def joined_tree(spark, d):
    """Subtrees of one level each, joined to whole paths."""
    p = table(spark, d, "part")
    none = F.lit(None).cast("long")
    top = p.select(F.lit("root").alias("tree"), F.col("p_brand").alias("name"), F.lit("040000").alias("mode"), F.lit("tree").alias("type"), F.col("p_brand").alias("sha"), none.alias("size")).distinct()
    both = F.concat("p_brand", F.lit("+"), "p_type")
    mid = p.select(F.col("p_brand").alias("tree"), F.col("p_type").alias("name"), F.lit("040000").alias("mode"), F.lit("tree").alias("type"), both.alias("sha"), none.alias("size")).distinct()
    leaf = p.select(both.alias("tree"), F.concat(F.col("p_partkey").cast("string"), F.lit(".js")).alias("name"), F.lit("100644").alias("mode"), F.lit("blob").alias("type"), F.sha1("p_name").alias("sha"), F.length("p_name").cast("long").alias("size"))
    return L.joined_tree(top.unionByName(mid).unionByName(leaf), "root").select("path", "type")


# --- modules ---------------------------------------------------------------------------------

@query("package_manifests", f"""SELECT DISTINCT package FROM (SELECT CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END AS package FROM (SELECT unnest(regexp_extract_all(l, '(?:from\\s+|require\\s*\\(\\s*)["'']([^"'']+)', 1)) AS s FROM (SELECT unnest(string_split(content, chr(10))) AS l FROM ({CODE.sql}))) WHERE NOT starts_with(s, '.') AND NOT starts_with(s, '/')
UNION ALL SELECT 'dep-' || p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION ALL SELECT 'dev-' || p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))""")
def package_manifests(spark, d):
    """Packages that files import or that the first of the brands' manifests names; one more is no JSON."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    named = lambda k: F.map_from_entries(F.transform("t", lambda x: F.struct(F.concat(F.lit(k), x), F.lit("1"))))
    manifest = p.select(F.concat("p_brand", F.lit("/package.json")).alias("path"), F.to_json(F.struct(named("dep-").alias("dependencies"), named("dev-").alias("devDependencies"))).alias("content"))
    broken = table(spark, d, "region").filter("r_regionkey = 0").select(F.lit("zz/package.json").alias("path"), F.lit("{").alias("content"))
    return E.dependencies(CODE.read(spark, d).unionByName(manifest).unionByName(broken))


def module_tables(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    paths = [
        p.filter("p_size % 2 = 0").select(F.concat("p_brand", F.lit("/src/"), size, F.lit(".ts"))),
        p.filter("p_size % 3 = 0").select(F.concat("p_brand", F.lit("/src/"), size, F.lit("/index.js"))),
        p.filter("p_size % 5 = 0").select(F.concat("p_brand", F.lit("/lib/"), size, F.lit(".d.ts"))),
        p.select(F.concat(F.lit("ws/"), F.lower("p_type"), F.lit("/main.ts"))),
    ]
    out = paths[0]
    for x in paths[1:]:
        out = out.union(x)
    files = p.select("p_brand").distinct().select(F.concat("p_brand", F.lit("/tsconfig.json")).alias("path"), F.lit('{ // c\n"compilerOptions": {"paths": {"~/*": ["src/*",], "~/x/*": ["none/*"]}, "baseUrl": "./"}}').alias("content"))
    own = p.select(F.lower("p_type").alias("t")).distinct().select(F.concat(F.lit("ws/"), "t", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "@ws/'), "t", F.lit('", "exports": {".": {"import": "./main.ts", "default": ["./main.js"]}}}')).alias("content"))
    return out.toDF("path").distinct(), M.module_configs(files), M.workspace_packages(own)


@query("resolve_modules", f"""WITH s AS (SELECT DISTINCT importer, specifier, split_part(importer, '/', 1) AS b, p_size, k FROM (SELECT importer, specifier, p_size, k FROM (SELECT {SPECIFIERS.columns['importer']} AS importer, {SPECIFIERS.columns['specifier']} AS specifier, p_size, p_partkey % 8 AS k FROM part))),
f AS (SELECT DISTINCT p_brand || '/src/' || p_size || '.ts' AS path FROM part WHERE p_size % 2 = 0 UNION SELECT p_brand || '/src/' || p_size || '/index.js' FROM part WHERE p_size % 3 = 0 UNION SELECT p_brand || '/lib/' || p_size || '.d.ts' FROM part WHERE p_size % 5 = 0 UNION SELECT 'ws/' || lower(p_type) || '/main.ts' FROM part),
t AS (SELECT importer, specifier, k, CASE WHEN k IN (0, 4) THEN [b || '/src/' || p_size || '.ts', b || '/src/' || p_size || '/index.js'] WHEN k IN (1, 5) THEN [b || '/lib/' || p_size || '.d.ts'] WHEN k = 2 THEN ['ws/' || specifier[5:] || '/main.ts'] ELSE [] END AS c FROM s),
x AS (SELECT importer, specifier, k, (SELECT coalesce(list_sort(list(DISTINCT path)), []) FROM f WHERE list_contains(t.c, path)) AS c FROM t)
SELECT importer, specifier, CASE WHEN k = 7 OR (k = 5 AND len(c) <> 1) THEN 'external' WHEN len(c) > 1 THEN 'ambiguous' WHEN len(c) = 1 THEN 'resolved' ELSE 'unresolved' END AS resolution, CASE WHEN k = 7 THEN '' ELSE array_to_string(c, ' ') END AS candidates, CASE WHEN k = 7 OR (k = 5 AND len(c) <> 1) THEN split_part(specifier, '/', 1) WHEN k = 3 THEN array_to_string(string_split(specifier, '/')[1:2], '/') END AS package FROM x""")
def resolve_modules(spark, d):
    out = M.resolve_modules(SPECIFIERS.read(spark, d), *module_tables(spark, d))
    return out.withColumn("candidates", F.array_join("candidates", " "))


@query("module_languages", "SELECT path, CASE WHEN regexp_matches(path, '(?i)\\.(js|jsx|mjs|cjs)$') THEN 'JavaScript' ELSE 'TypeScript' END AS language, CASE WHEN ends_with(path, '.tsx') THEN 'TSX' WHEN ends_with(path, '.JSX') THEN 'JSX' WHEN regexp_matches(path, '(?i)\\.(js|mjs|cjs)$') THEN 'JS' ELSE 'TS' END AS kind FROM (SELECT p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.JSX' WHEN 3 THEN '.mjs' WHEN 4 THEN '.d.ts' ELSE '.Cjs' END AS path FROM part)")
def module_languages(spark, d):
    k = F.col("p_partkey") % 6
    path = F.concat(F.col("p_partkey").cast("string"), F.when(k == 0, ".ts").when(k == 1, ".tsx").when(k == 2, ".JSX").when(k == 3, ".mjs").when(k == 4, ".d.ts").otherwise(".Cjs"))
    p = table(spark, d, "part").select(path.alias("path"))
    return p.select("path", M.script_language(F.col("path")).alias("language"), M.script_kind(F.col("path")).alias("kind"))


@query("resolve_names", """WITH s AS (SELECT p_brand AS path, p_type AS name, min(p_partkey) AS id FROM part GROUP BY 1, 2), u AS (SELECT DISTINCT n_nationkey::VARCHAR AS path, p_type AS name FROM nation, part),
i AS (SELECT n_nationkey::VARCHAR AS path, 'Brand#' || (1 + n_nationkey % 25) AS target FROM nation WHERE n_nationkey % 3 <> 0)
SELECT u.path, u.name, s.id::VARCHAR AS id FROM u LEFT JOIN i ON i.path = u.path LEFT JOIN s ON s.path = i.target AND s.name = u.name""")
def resolve_names(spark, d):
    """Names that nations' files use, two thirds of which import one brand's symbols."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    symbols = p.select(F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("place"))
    names = p.select(F.col("p_type").alias("name")).distinct()
    files = n.select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 25 + 1).cast("string")).alias("target"), F.lit(1).alias("one"))
    uses = files.select("path", "one").join(names.withColumn("one", F.lit(1)), "one").select("path", "name")  # 25 files by the few types
    imports = files.filter("cast(path AS int) % 3 <> 0").select("path", "target", F.lit(1).alias("one")).join(names.withColumn("one", F.lit(1)), "one").select("path", "name", "target", F.col("name").alias("imported"))
    return M.resolve_names(uses, imports, symbols)


@query("resolve_members", """
WITH s AS (SELECT p_brand AS path, p_type AS name, min(p_partkey) FILTER (p_size % 3 <> 0) AS id FROM part GROUP BY 1, 2),
u AS (SELECT DISTINCT n_nationkey AS n, p_type AS name FROM nation, part)
SELECT n::VARCHAR AS path, 'brand' AS qualifier, u.name, s.id::VARCHAR AS id FROM u LEFT JOIN s ON n % 3 <> 0 AND s.path = 'Brand#' || (11 + n % 5) AND s.name = u.name""")
def resolve_members(spark, d):
    """Members of a namespace that nations' files use; a third has no such namespace, and parts of other symbols are no
    members."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    parent = F.when(F.col("p_size") % 3 == 0, "other")
    symbols = p.select(F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("place"), parent.alias("parent"))
    names = p.select(F.col("p_type").alias("name")).distinct().withColumn("one", F.lit(1))
    files = n.select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 5 + 11).cast("string")).alias("target"), F.lit(1).alias("one"))
    uses = files.join(names, "one").select("path", F.lit("brand").alias("qualifier"), "name")  # 25 files by the few types
    namespaces = files.filter("cast(path AS int) % 3 <> 0").select("path", F.lit("brand").alias("name"), "target")
    return M.resolve_members(uses, namespaces, symbols)


# --- jobs ------------------------------------------------------------------------------------

#: Deliveries in each job's order folded one by one; what: what each came to, given the state before it.
REPLAY = f"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY place) AS n FROM ({MESSAGES.sql})),
w AS (
  SELECT DISTINCT job_id, 0::BIGINT AS n, 'queued' AS status, 'inventory' AS stage, NULL::VARCHAR AS cursor, 0::BIGINT AS done, 0::BIGINT AS total, 0 AS moves, NULL::VARCHAR AS what, NULL::BIGINT AS place, NULL::VARCHAR AS came FROM m
  UNION ALL
  SELECT job_id, n,
         CASE what WHEN 'failed' THEN 'failed' WHEN 'inv' THEN 'running' WHEN 'more' THEN 'running' WHEN 'last' THEN 'running' WHEN 'end' THEN 'succeeded' ELSE status END,
         CASE what WHEN 'inv' THEN 'fetch-content' WHEN 'last' THEN 'analyze' WHEN 'end' THEN 'complete' ELSE stage END,
         CASE what WHEN 'inv' THEN '0' WHEN 'more' THEN least(total, done + 10)::VARCHAR WHEN 'last' THEN least(total, done + 10)::VARCHAR ELSE cursor END,
         CASE what WHEN 'inv' THEN 0 WHEN 'more' THEN least(total, done + 10) WHEN 'last' THEN least(total, done + 10) ELSE done END,
         CASE what WHEN 'inv' THEN fresh ELSE total END,
         moves + CASE WHEN what IN ('inv', 'more', 'last', 'end', 'failed') THEN 1 ELSE 0 END, what, place, came
  FROM (SELECT w.job_id, m.n, m.place, w.status, w.stage, w.cursor, w.done, w.total, w.moves, m.total AS fresh, m.cursor AS came,
               CASE WHEN w.status IN ('succeeded', 'failed') THEN 'ended' WHEN w.stage <> m.stage OR (m.cursor IS NOT NULL AND w.cursor IS DISTINCT FROM m.cursor) THEN 'stale'
                    WHEN m.fails = 'again' AND w.moves < 3 THEN 'retry' WHEN m.fails IS NOT NULL THEN 'failed' WHEN m.stage = 'inventory' THEN 'inv' WHEN m.stage = 'analyze' THEN 'end'
                    WHEN least(w.total, w.done + 10) >= w.total THEN 'last' ELSE 'more' END AS what
        FROM w JOIN m ON m.job_id = w.job_id AND m.n = w.n + 1))"""


@query("job_replay", REPLAY + """
SELECT job_id, status, stage, cursor, done, total, moves FROM w QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1""")
def job_replay(spark, d):
    """Where each job ends after all of its deliveries, in order: compare and set by stage and cursor."""
    return J.replay(MESSAGES.read(spark, d))


@query("job_stream", REPLAY + """
SELECT job_id, place, CASE WHEN what IN ('inv', 'more', 'last', 'end') THEN 'moved' ELSE what END AS outcome, status, stage, cursor, done, total,
       CASE WHEN status IN ('queued', 'running') THEN stage END AS send_stage,
       CASE WHEN what = 'retry' THEN came WHEN status = 'running' AND stage = 'fetch-content' THEN cursor END AS send_cursor
FROM w WHERE n > 0""")
def job_stream(spark, d):
    """What became of each delivery and which message it sends: the next one, or, after a stale or repeated delivery, the
    job's continuation.  A stream with typed state, stopped and started again twice."""
    m = MESSAGES.read(spark, d)
    base = shared_folder(spark)
    cuts = [float("-inf"), *m.agg(F.percentile_approx("place", [0.3, 0.7])).first()[0], float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        m.filter((F.col("place") > low) & (F.col("place") <= high)).write.mode("append").parquet(f"{base}/in")
        ST.run_to_end(ST.job_stream(spark.readStream.schema(m.schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out").filter("what = 'delivery'")
    return out.select("job_id", "place", "outcome", "status", "stage", "cursor", "done", "total", "send_stage", "send_cursor")


# --- navigation ------------------------------------------------------------------------------

@query("remote_payload", f"SELECT snapshot, path FROM ({ENTRIES.sql}) WHERE kind = 'blob'")
def remote_payload(spark, d):
    """What a client gets of a manifest: paths of its files."""
    return ENTRIES.read(spark, d).filter("kind = 'blob'").select("snapshot", "path")


@query("analyzed_files", f"SELECT repo, path, max(pos) AS pos FROM ({FILE_LIST.sql}) WHERE (repo, path) IN (SELECT repo, path FROM ({FILE_LIST.sql}) WHERE pos % 3 <> 0) GROUP BY repo, path")
def analyzed_files(spark, d):
    f = FILE_LIST.read(spark, d)
    return P.analyzed_files(f.filter("pos % 3 <> 0"), f)


@query("job_navigation", "SELECT o_orderkey AS job, c_custkey AS snapshot, n_name AS repository FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'F'")
def job_navigation(spark, d):
    """Jobs that haven't ended, with their snapshot and its repository, by foreign keys."""
    o = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("snapshot"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("snapshot"), F.col("c_nationkey").alias("n"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("repository"))
    return o.join(c, "snapshot").join(n, "n").select("job", "snapshot", "repository")


@query("text_positions", "SELECT doc_id, (length(b) - length(replace(b, chr(10), '')) + 1)::INTEGER AS line, (length(string_split(b, chr(10))[-1]) + 1)::INTEGER AS column FROM (SELECT doc_id, text[1:(length(text) * 2) // 3] AS b FROM documents WHERE text IS NOT NULL)")
def text_positions(spark, d):
    """Line and column of the place two thirds into each text."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", X.position(F.col("text"), F.floor(F.length("text") * 2 / 3).cast("int")).alias("p")).select("doc_id", "p.line", "p.column")
