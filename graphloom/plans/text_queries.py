"""Queries over paths, file text, admission and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import extract as E
from graphloom.operators import reports as R
from graphloom.operators import resolve as M
from graphloom.operators import tree as T
from graphloom.plans.registry import query
from graphloom.sources.fixture import SQL as FX
from graphloom.sources.fixture import edges, nodes, table
from graphloom.sources.records import BLOBS, CODE, FILES, KNOWLEDGE, ROUTE_FILES
from graphloom.streaming import jobs as J

PATHS = FX + ", p AS (SELECT DISTINCT path FROM fx_nodes WHERE path IS NOT NULL)"


def paths(spark, d):
    return nodes(spark, d).filter(F.col("path").isNotNull()).select("path").distinct()


@query("repo_url_parse", r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 1) AS owner,
regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 2) AS repo, NOT regexp_matches(url, '[?#]') AS plain FROM pages""")
def repo_url_parse(spark, d):
    two = r"^https?://[^/]+/([^/?#]+)/([^/?#]+)"
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.parse_url(u, F.lit("HOST")), F.lit("")).alias("host"), F.regexp_extract(u, two, 1).alias("owner"), F.regexp_extract(u, two, 2).alias("repo"), (~u.rlike("[?#]")).alias("plain"))


@query("top_dirs", PATHS + " SELECT split_part(path, '/', 1) AS dir, count(*) AS files FROM p GROUP BY 1 ORDER BY files DESC, dir LIMIT 12")
def top_dirs(spark, d):
    return paths(spark, d).groupBy(X.first_segment(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "dir").limit(12)


@query("extension_counts", PATHS + " SELECT lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS extension, count(*) AS files FROM p GROUP BY 1 ORDER BY files DESC, 1 LIMIT 10".replace("\\\\", "\\"))
def extension_counts(spark, d):
    return paths(spark, d).groupBy(X.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "extension").limit(10)


@query("dir_extensions", PATHS + """, c AS (SELECT split_part(path, '/', 1) AS dir, lower(split_part(path, '.', -1)) AS extension, count(*) AS files FROM p GROUP BY 1, 2)
SELECT dir, extension, files FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY files DESC, extension) AS r FROM c) WHERE r <= 4""")
def dir_extensions(spark, d):
    c = paths(spark, d).groupBy(X.first_segment(F.col("path")).alias("dir"), X.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    best = c.groupBy("dir").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("m"), "extension"))), 1, 4).alias("x"))  # extensions are few
    return best.select("dir", F.explode("x").alias("x")).select("dir", "x.extension", (-F.col("x.m")).alias("files"))


@query("arch_left_join", PATHS + """, t AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS files FROM p GROUP BY 1), s AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS nodes FROM fx_nodes WHERE kind = 'symbol' GROUP BY 1)
SELECT t.dir, files, coalesce(nodes, 0) AS nodes, floor(files * 100 / (SELECT count(*) FROM p) + 0.5)::BIGINT AS percent FROM t LEFT JOIN s USING (dir)""")
def arch_left_join(spark, d):
    t = paths(spark, d).groupBy(X.first_segment(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    s = nodes(spark, d).filter("kind = 'symbol'").groupBy(X.first_segment(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("nodes"))
    total = paths(spark, d).agg(F.count(F.lit(1)).alias("all"))
    return t.join(s, "dir", "left").crossJoin(total).select("dir", "files", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.floor(F.col("files") * 100 / F.col("all") + 0.5).alias("percent"))


@query("tree_rollup", PATHS + ", x AS (SELECT path, string_split(path, '/') AS s FROM p), y AS (SELECT s, unnest(range(1, len(s))) AS n FROM x) SELECT array_to_string(s[1:n], '/') AS folder, count(*) AS files FROM y GROUP BY 1")
def tree_rollup(spark, d):
    folders = paths(spark, d).select(F.explode(M.directories(F.col("path"))).alias("folder"))
    return folders.filter("folder <> ''").groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


@query("ordered_tree", PATHS + """,
x AS (SELECT DISTINCT string_split(path, '/') AS s FROM p),
y AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM x),
t AS (SELECT DISTINCT s[1:n] AS s, n = len(s) AS is_file FROM y),
k AS (SELECT array_to_string(s, '/') AS path, s[-1] AS name, CASE WHEN is_file THEN 'file' ELSE 'folder' END AS kind, len(s) AS depth,
             list_append(list_transform(s[1:len(s) - 1], lambda v: '0' || v), CASE WHEN is_file THEN '1' ELSE '0' END || s[-1]) AS key FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS place FROM k),
inside AS (SELECT array_to_string(s[1:m], '/') AS path, count(*) FILTER (is_file) AS files, count(*) AS nodes FROM (SELECT s, is_file, unnest(range(1, len(s))) AS m FROM t) GROUP BY 1)
SELECT r.path, name, kind, depth::INTEGER AS depth, CASE WHEN kind = 'file' THEN 1 ELSE files END AS files, place, place + coalesce(nodes, 0) AS last FROM r LEFT JOIN inside ON inside.path = r.path AND kind = 'folder'""")
def ordered_tree(spark, d):
    """The tree as it is shown: folders first, each before what is in it, with counts and the places of what is in it."""
    return T.ordered_tree(paths(spark, d)).select("path", "name", "kind", "depth", "files", "place", "last")


@query("tree_match_count", PATHS + " SELECT count(*) FILTER (contains(lower(path), 'brass')) AS matches, count(*) AS files FROM p")
def tree_match_count(spark, d):
    return T.matches(paths(spark, d), "Brass")


@query("path_neighbors", PATHS + " SELECT path FROM p WHERE (split_part(path, '/', 1) = 'orders' OR split_part(split_part(path, '/', -1), '.', 1) = '1995') AND path <> 'orders/1995.ts' ORDER BY path LIMIT 20")
def path_neighbors(spark, d):
    return M.path_neighbors(paths(spark, d), "orders/1995.ts")


@query("normalize_path", "SELECT p_partkey, './' || p_brand || '//' || replace(p_name, ' ', chr(92)) AS raw, p_brand || '/' || replace(p_name, ' ', '/') AS path FROM part")
def normalize_path(spark, d):
    raw = F.concat(F.lit("./"), "p_brand", F.lit("//"), F.replace("p_name", F.lit(" "), F.lit("\\")))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"), X.normalize_path(raw).alias("path"))


@query("resolve_dotdot", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'b/' || p_brand ELSE 'a/' || p_brand END AS path FROM part")
def resolve_dotdot(spark, d):
    kind = F.col("p_size") % 3
    raw = F.when(kind == 0, F.concat(F.lit("a/../../"), "p_brand")).when(kind == 1, F.concat(F.lit("a/../b/./"), "p_brand")).otherwise(F.concat(F.lit("a/x/../"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", X.resolve_dots(raw).alias("path"))


@query("safe_path_violations", "SELECT p_partkey FROM part WHERE p_size % 5 IN (0, 1, 2, 3)")
def safe_path_violations(spark, d):
    k = F.col("p_size") % 5
    raw = F.when(k == 0, F.concat(F.lit("/"), "p_brand")).when(k == 1, F.concat("p_brand", F.lit("/../x"))).when(k == 2, F.concat("p_brand", F.lit("\\x"))).when(k == 3, F.concat("p_brand", F.lit("//x"))).otherwise(F.concat("p_brand", F.lit("/x.ts")))
    return table(spark, d, "part").filter(~X.safe_path(raw)).select("p_partkey")


@query("human_bytes", """SELECT p_partkey, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(b * 10 / 1048576.0 + 0.5) / 10) END AS size
FROM (SELECT p_partkey, p_partkey * p_size AS b FROM part)""")
def human_bytes(spark, d):
    return table(spark, d, "part").select("p_partkey", X.human_bytes(F.col("p_partkey") * F.col("p_size")).alias("size"))


@query("job_identity", "SELECT event_id, 'job_' || substr(sha256(event_type || chr(0) || user_id), 1, 32) AS job FROM events")
def job_identity(spark, d):
    return table(spark, d, "events").select("event_id", X.identity("job_", F.col("event_type"), F.col("user_id").cast("string"), digits=32).alias("job"))


# --- file text -------------------------------------------------------------------------------

LINES = f"l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, length(content) - length(replace(content, chr(10), '')) + 2)) AS line FROM ({CODE.sql}))"
IMPORTS = LINES + """, i AS (SELECT path, line, CASE WHEN contains(text, 'require') THEN 'require' ELSE 'import' END AS kind, unnest(regexp_extract_all(text, '(?:from\\s+|require\\s*\\(\\s*)["'']([^"'']+)', 1)) AS specifier FROM l),
im AS (SELECT path, line, kind, specifier, CASE WHEN NOT starts_with(specifier, '.') AND NOT starts_with(specifier, '/') THEN CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE split_part(specifier, '/', 1) END END AS package FROM i)"""
SYMBOLS = LINES + """, sy AS (SELECT path, line, regexp_extract(text, 'function|class|interface|type|const|let') AS kind, regexp_extract(text, '(?:export\\s+)?(?:async\\s+)?(?:function|class|interface|type|const|let)\\s+([A-Za-z_$][\\w$]*)', 1) AS name FROM l WHERE regexp_matches(text, '(function|class|interface|type|const|let)\\s+[A-Za-z_$]'))"""
ROUTES = LINES + """, ro AS (SELECT path, line, upper(regexp_extract(text, '(?i)(?:app|router)\\.(get|post|put|patch|delete)\\s*\\(\\s*["''`]([^"''`]+)', 1)) AS method, regexp_extract(text, '(?i)(?:app|router)\\.(get|post|put|patch|delete)\\s*\\(\\s*["''`]([^"''`]+)', 2) AS route FROM l
WHERE regexp_matches(text, '(?i)(?:app|router)\\.(get|post|put|patch|delete)\\s*\\(\\s*["''`][^"''`]'))"""
FOUND = """SELECT {key}, line, 'Possible hard-coded credential' AS title FROM l WHERE regexp_matches(text, '(?i)(?:password|token|secret|api[_-]?key)\\s*[:=]\\s*["''][^"'']{{8,}}["'']') AND NOT regexp_matches(text, '(?i)(process\\.env|import\\.meta\\.env|example|placeholder|test)')
UNION ALL SELECT {key}, line, 'Dynamic code execution' FROM l WHERE regexp_matches(text, '\\beval\\s*\\(|new Function\\s*\\(')"""


def code(spark, d):
    return CODE.read(spark, d)


@query("import_edges", f"WITH {IMPORTS} SELECT path, line::INTEGER AS line, kind, specifier, package FROM im")
def import_edges(spark, d):
    return E.imports(code(spark, d))


@query("dependencies", f"WITH {IMPORTS} SELECT package, count(*) AS uses FROM im WHERE package IS NOT NULL GROUP BY 1")
def dependencies(spark, d):
    return E.imports(code(spark, d)).filter("package IS NOT NULL").groupBy("package").agg(F.count(F.lit(1)).alias("uses"))


@query("symbol_scan", f"WITH {SYMBOLS} SELECT path, line::INTEGER AS line, kind, name FROM sy")
def symbol_scan(spark, d):
    return E.symbols(code(spark, d))


@query("glossary_terms", f"WITH {SYMBOLS} SELECT name, kind, path, line::INTEGER AS line FROM sy WHERE regexp_matches(name, '^[A-Z][A-Za-z]+$') ORDER BY path, line LIMIT 30")
def glossary_terms(spark, d):
    return E.terms(code(spark, d))


@query("route_scan", f"WITH {ROUTES} SELECT path, line::INTEGER AS line, method, route FROM ro")
def route_scan(spark, d):
    return E.routes(code(spark, d))


@query("local_answer", f"""WITH {SYMBOLS}, {ROUTES.removeprefix(LINES + ", ")}, a AS (SELECT path || ':' || line AS e, path, line FROM sy WHERE regexp_matches(name || path, '(?i)auth|login|session')), t AS (SELECT name || ' — ' || path || ':' || line AS e, path, line FROM sy WHERE contains(lower(name || path), 'find') OR contains(lower(name || path), 'gizmo') OR contains(lower(name || path), 'the')),
r AS (SELECT method || ' ' || route || ' — ' || path AS e, path, line FROM ro)
SELECT 'login' AS asked, 0 AS place, 'No authentication implementation verified' AS title, NULL AS evidence WHERE NOT EXISTS (SELECT 1 FROM a)
UNION ALL SELECT 'routes', (row_number() OVER (ORDER BY path, line, e))::INTEGER, (SELECT count(*) FROM r) || ' route definitions detected', e FROM r QUALIFY row_number() OVER (ORDER BY path, line, e) <= 10
UNION ALL SELECT 'names', (row_number() OVER (ORDER BY path, line, e))::INTEGER, (SELECT least(count(*), 10) FROM t) || ' relevant definitions found', e FROM t QUALIFY row_number() OVER (ORDER BY path, line, e) <= 10""")
def local_answer(spark, d):
    """What the content model answers: to a question of login, one of routes and one of names."""
    c = code(spark, d)
    symbols, routes = E.symbols(c), E.routes(c)
    out = None
    for asked, question in (("login", "Where is login handled?"), ("routes", "Which API routes are there?"), ("names", "find the Gizmo")):
        part = R.local_answer(question, symbols, routes).select(F.lit(asked).alias("asked"), "place", "title", "evidence")
        out = part if out is None else out.unionByName(part)
    return out


@query("content_model", f"""WITH {IMPORTS}, {SYMBOLS.removeprefix(LINES + ", ")}, {ROUTES.removeprefix(LINES + ", ")}, se AS (SELECT DISTINCT title, path FROM ({FOUND.format(key="path")})),
x AS (SELECT 'edges' AS list, path || ':' || line || ':' || specifier AS item FROM (SELECT * FROM im ORDER BY path, line, specifier LIMIT 800)
UNION ALL SELECT 'symbols', path || ':' || line || ':' || name FROM (SELECT * FROM sy ORDER BY path, line LIMIT 1500) UNION ALL SELECT 'routes', path || ':' || line || ':' || route FROM (SELECT * FROM ro ORDER BY path, line LIMIT 300)
UNION ALL SELECT DISTINCT 'dependencies', package FROM im WHERE package IS NOT NULL UNION ALL SELECT 'terms', path || ':' || line || ':' || name FROM (SELECT * FROM sy WHERE regexp_matches(name, '^[A-Z][A-Za-z]+$') ORDER BY path, line LIMIT 30)
UNION ALL SELECT 'security', title || ':' || path FROM se) SELECT list, count(*) AS n, sha256(string_agg(item, chr(10) ORDER BY item)) AS digest FROM x GROUP BY list""")
def content_model(spark, d):
    """Every list of the content model: its length and a digest of its items."""
    lists = E.content_model(code(spark, d))
    place = lambda last: F.concat_ws(":", "path", F.col("line").cast("string"), last)
    items = {"edges": place("specifier"), "symbols": place("name"), "routes": place("route"), "dependencies": F.col("package"), "terms": place("name"), "security": F.concat_ws(":", "title", "path")}
    out = None
    for name, item in items.items():
        part = lists[name].select(F.lit(name).alias("list"), item.alias("item"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), "\n"), 256).alias("digest"))  # lists have largest lengths


KNOWN = f"""k AS ({KNOWLEDGE.sql}), l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, length(content) - length(replace(content, chr(10), '')) + 2)) AS line FROM k),
h AS (SELECT path, line, length(regexp_extract(text, '^(#{{1,3}})\\s+([^\\r\\n]+)$', 1)) AS level, trim(regexp_extract(text, '^(#{{1,3}})\\s+([^\\r\\n]+)$', 2)) AS title FROM l WHERE regexp_matches(text, '^#{{1,3}}\\s+[^\\r\\n]+$')),
n AS (SELECT path, line, upper(regexp_extract(text, '(?i)//\\s*(NOTE|WHY|HACK|ADR|TODO):\\s*([^\\r\\n]+)$', 1)) AS tag, trim(regexp_extract(text, '(?i)//\\s*(NOTE|WHY|HACK|ADR|TODO):\\s*([^\\r\\n]+)$', 2)) AS note FROM l WHERE regexp_matches(text, '(?i)//\\s*(NOTE|WHY|HACK|ADR|TODO):\\s*[^\\r\\n]+$')),
q AS (SELECT path, string_split(content, ';') AS parts FROM k), q2 AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM q),
q3 AS (SELECT path, array_to_string(parts[1:i - 1], ';') || CASE WHEN i > 1 THEN ';' ELSE '' END AS upto, parts[i] AS part, regexp_extract(parts[i], '(?is)^(.*?)CREATE\\s+TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?[`"'']?([a-zA-Z0-9_]+)[`"'']?\\s*\\((.+)\\)', ['head', 'name', 'body']) AS m FROM q2),
t AS (SELECT path, length(upto || m.head) - length(replace(upto || m.head, chr(10), '')) + 1 AS line, m.name AS name,
  list_filter(list_transform(string_split(m.body, ','), lambda c: regexp_replace(regexp_extract(trim(regexp_replace(c, '\\s', ' ', 'g')), '^\\S*'), '[`"'']', '', 'g')), lambda c: c <> '' AND NOT regexp_matches(c, '(?i)^(PRIMARY|FOREIGN|KEY|CONSTRAINT|INDEX|UNIQUE)')) AS fields FROM q3 WHERE m.name <> '')"""


@query("markdown_headings", f"WITH {KNOWN} SELECT path, line::INTEGER AS line, level::INTEGER AS level, title FROM h")
def markdown_headings(spark, d):
    return E.headings(KNOWLEDGE.read(spark, d))


@query("rationale_comments", f"WITH {KNOWN} SELECT path, line::INTEGER AS line, tag, note FROM n")
def rationale_comments(spark, d):
    return E.rationale(KNOWLEDGE.read(spark, d))


@query("sql_tables", f"WITH {KNOWN} SELECT path, line::INTEGER AS line, name, array_to_string(fields, ',') AS fields FROM t")
def sql_tables(spark, d):
    return E.sql_tables(KNOWLEDGE.read(spark, d)).select("path", "line", "name", F.array_join("fields", ",").alias("fields"))


KNOWN_IDS = KNOWN + """, kn AS (SELECT 'document:' || path AS id, 'file' AS kind, split_part(path, '/', -1) AS name, path FROM k WHERE ends_with(path, '.md')
UNION SELECT 'document:' || path || '#line-' || line, 'symbol', title, path FROM h WHERE ends_with(path, '.md') UNION SELECT 'file:' || path, 'file', split_part(path, '/', -1), path FROM k WHERE ends_with(path, '.sql')
UNION SELECT 'schema:' || path || ':' || name, 'schema', name, path FROM t WHERE ends_with(path, '.sql') UNION SELECT 'symbol:' || path || ':rationale-' || line, 'symbol', tag || ': ' || note[1:30], path FROM n),
ke AS (SELECT 'document:' || path AS src, 'document:' || path || '#line-' || line AS dst, 'contains' AS kind FROM h WHERE ends_with(path, '.md') UNION SELECT 'file:' || path, 'schema:' || path || ':' || name, 'declares' FROM t WHERE ends_with(path, '.sql')
UNION SELECT 'file:' || path, 'symbol:' || path || ':rationale-' || line, 'contains' FROM n)"""


@query("knowledge_nodes", f"WITH {KNOWN_IDS} SELECT id, kind, name, path FROM kn")
def knowledge_nodes(spark, d):
    return E.knowledge(KNOWLEDGE.read(spark, d))[0].select("id", "kind", "name", "path")


@query("knowledge_edges", f"WITH {KNOWN_IDS} SELECT 'edge:' || src || '->' || dst || ':' || kind AS id, src, dst, kind FROM ke")
def knowledge_edges(spark, d):
    return E.knowledge(KNOWLEDGE.read(spark, d))[1].select("id", "src", "dst", "kind")


@query("enrich_union", FX + f""", {KNOWN_IDS}, own AS (SELECT id FROM fx_nodes UNION SELECT 'symbol:src/' || p_partkey || '.ts:rationale-1' FROM part WHERE p_size > 25)
SELECT 'node' AS what, kind, count(*) AS n FROM (SELECT kind FROM fx_nodes UNION ALL SELECT 'package' FROM part WHERE p_size > 25 UNION ALL SELECT kind FROM kn WHERE id NOT IN (SELECT id FROM own)) GROUP BY ALL
UNION ALL SELECT 'edge', kind, count(*) FROM (SELECT kind FROM fx_edges UNION ALL SELECT kind FROM ke) GROUP BY ALL""")
def enrich_union(spark, d):
    """The projected graph with what texts give; some ids stand in both, and there the graph's own wins."""
    p = table(spark, d, "part").filter("p_size > 25")
    own = nodes(spark, d).select("id", "kind", "name", "path").unionByName(p.select(F.concat(F.lit("symbol:src/"), F.col("p_partkey").cast("string"), F.lit(".ts:rationale-1")).alias("id"), F.lit("package").alias("kind"), F.lit("own").alias("name"), F.lit(None).cast("string").alias("path")))
    edge_id = F.concat_ws("|", "src", "dst", "kind")
    n, e = E.enrich(own, edges(spark, d), edge_id, KNOWLEDGE.read(spark, d))
    return n.select(F.lit("node").alias("what"), "kind").unionByName(e.select(F.lit("edge").alias("what"), "kind")).groupBy("what", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("unsupported_files", f"SELECT 'SOURCE_FILE_UNSUPPORTED' AS code, 'warning' AS severity, 'No TypeScript extractor support for analyzed source file ' || path AS message, path FROM ({FILES.sql}) WHERE NOT regexp_matches(path, '(?i)\\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)$') AND NOT regexp_matches(path, '(?:^|/)(?:tsconfig|package)\\.json$')")
def unsupported_files(spark, d):
    return E.unsupported(FILES.read(spark, d))


@query("credential_scan", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, length(text) - length(replace(text, chr(10), '')) + 2)) AS line FROM documents) SELECT doc_id, line::INTEGER AS line, title FROM ({FOUND.format(key="doc_id")})""")
def credential_scan(spark, d):
    """Lines of documents that hold a credential or run text as code."""
    return E.findings(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))).withColumnRenamed("path", "doc_id")


@query("code_findings", f"WITH {LINES} SELECT path, line::INTEGER AS line, title FROM ({FOUND.format(key="path")})")
def code_findings(spark, d):
    return E.findings(code(spark, d))


@query("dynamic_exec_scan", r"SELECT page_id, regexp_matches(html, '\beval\s*\(|new Function\s*\(') AS dynamic FROM pages")
def dynamic_exec_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").rlike(E.DYNAMIC).alias("dynamic"))


@query("blob_decode", f"""SELECT p_partkey, CASE WHEN encoding = 'utf-8' THEN sha256(content) WHEN encoding = 'base64' AND regexp_matches(regexp_replace(content, '\\s', '', 'g'), '^(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?$') THEN sha256(from_base64(regexp_replace(content, '\\s', '', 'g'))) END AS digest FROM ({BLOBS.sql})""")
def blob_decode(spark, d):
    return BLOBS.read(spark, d).select("p_partkey", F.sha2(E.decode_blob(F.col("content"), F.col("encoding")), 256).alias("digest"))


@query("blob_admission", f"""SELECT p_partkey, encoding = 'utf-8' OR (encoding = 'base64' AND p_partkey % 6 IN (0, 1, 5)) AS admitted FROM ({BLOBS.sql})""")
def blob_admission(spark, d):
    """Which decoded blobs are text; those that hold a NUL byte or don't decode are not."""
    return BLOBS.read(spark, d).select("p_partkey", E.admissible_bytes(E.decode_blob(F.col("content"), F.col("encoding"))).alias("admitted"))


@query("page_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def page_links(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("text_admission", r"""SELECT doc_id, NOT contains(text, chr(0)) AND len(regexp_extract_all(text, '[\x01-\x08\x0B\x0C\x0E-\x1F]')) <= greatest(1.0, length(text) / 100.0) AS admitted FROM documents""")
def text_admission(spark, d):
    return table(spark, d, "documents").select("doc_id", E.admissible(F.col("text")).alias("admitted"))


@query("next_route_path", rf"""
WITH p AS ({ROUTE_FILES.sql}),
m AS (SELECT p_partkey, path, regexp_extract(path, '(?i)(?:^|/)app((?:/.*)?)/(?:route|page)\.[cm]?[jt]sx?$', 1) AS below, regexp_extract(path, '(?i)(?:^|/)app(?:/.*)?/(route|page)\.[cm]?[jt]sx?$', 1) AS what,
             '/api' || nullif(regexp_extract(path, '(?i)(?:^|/)pages/api(/.+)\.[cm]?[jt]sx?$', 1), '') AS pages FROM p),
s AS (SELECT *, array_to_string(list_filter(string_split(below, '/'), lambda x: NOT (x = '' OR x[1] = '@' AND length(x) > 1 OR x[1] = '(' AND x[-1] = ')' AND length(x) > 2)), '/') AS app FROM m)
SELECT p_partkey, path, CASE WHEN what <> '' THEN CASE WHEN app = 'index' THEN '/' WHEN suffix(app, '/index') THEN '/' || app[:-7] ELSE '/' || app END
                             WHEN pages IS NOT NULL THEN CASE WHEN suffix(pages, '/index') THEN pages[:-7] ELSE pages END END AS route,
       CASE WHEN what <> '' THEN what = 'route' WHEN pages IS NOT NULL THEN true END AS api, CASE WHEN what <> '' THEN what = 'page' WHEN pages IS NOT NULL THEN false END AS page FROM s""")
def next_route_path(spark, d):
    """Routes of files by their paths: pages and handlers in all forms, groups, slots, letters of either case."""
    p = ROUTE_FILES.read(spark, d).withColumn("r", E.next_route(F.col("path")))
    return p.select("p_partkey", "path", "r.route", "r.api", "r.page")


@query("module_probe", """WITH f AS (SELECT p_brand || '/' || p_size || e AS path FROM part, (SELECT unnest(['.ts', '/index.js', '.d.ts']) AS e) WHERE (e = '.ts' AND p_partkey % 2 = 0) OR (e = '/index.js' AND p_partkey % 3 = 0) OR (e = '.d.ts' AND p_partkey % 5 = 0)),
b AS (SELECT DISTINCT p_brand || '/' || p_size || CASE WHEN p_size % 4 = 0 THEN '.mjs' ELSE '' END AS base, p_brand || '/' || p_size AS stem, p_size % 4 = 0 AS script FROM part),
m AS (SELECT base, count(DISTINCT path) AS matches, coalesce(string_agg(DISTINCT path, ' ' ORDER BY path), '') AS candidates FROM b LEFT JOIN f ON path IN (stem || '.ts', stem || '.d.ts') OR (NOT script AND path = stem || '/index.js') GROUP BY base)
SELECT base, matches, candidates, CASE WHEN matches > 1 THEN 'ambiguous' WHEN matches = 1 THEN 'resolved' ELSE 'unresolved' END AS status FROM m""")
def module_probe(spark, d):
    p = table(spark, d, "part").withColumn("stem", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")))
    file = lambda n, end: p.filter(f"p_partkey % {n} = 0").select(F.concat("stem", F.lit(end)).alias("path"))
    bases = p.select(F.concat("stem", F.when(F.col("p_size") % 4 == 0, ".mjs").otherwise("")).alias("base"))
    return M.probe(bases, file(2, ".ts").union(file(3, "/index.js")).union(file(5, ".d.ts"))).withColumn("candidates", F.array_join("candidates", " "))


@query("alias_match", """WITH a AS (SELECT DISTINCT p_brand AS prefix, '' AS suffix FROM part UNION SELECT 'Brand#', 's'), s AS (SELECT DISTINCT p_brand || '/' || p_type AS specifier FROM part),
r AS (SELECT specifier, prefix, suffix, row_number() OVER (PARTITION BY specifier ORDER BY length(prefix) + length(suffix) DESC, prefix DESC, suffix DESC) AS n FROM s JOIN a ON starts_with(specifier, prefix) AND ends_with(specifier, suffix) AND length(specifier) >= length(prefix) + length(suffix))
SELECT specifier, prefix, suffix FROM r WHERE n = 1""")
def alias_match(spark, d):
    p = table(spark, d, "part")
    aliases = p.select(F.col("p_brand").alias("prefix"), F.lit("").alias("suffix")).union(spark.createDataFrame([("Brand#", "s")], "prefix string, suffix string")).distinct()
    return M.alias_match(p.select(F.concat("p_brand", F.lit("/"), "p_type").alias("specifier")).distinct(), aliases)


@query("nearest_config", PATHS + """, c AS (SELECT DISTINCT 'catalog/' || p_brand AS dir FROM part WHERE p_size % 2 = 0 UNION SELECT 'geo' UNION SELECT 'catalog')
SELECT path, arg_max(dir, length(dir)) AS dir FROM p JOIN c ON starts_with(path, dir || '/') GROUP BY path""")
def nearest_config(spark, d):
    configs = table(spark, d, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("catalog/"), "p_brand").alias("dir"))
    return M.nearest_config(paths(spark, d), configs.union(spark.createDataFrame([("geo",), ("catalog",)], "dir string")))


@query("dedupe_findings", "SELECT event_type AS title, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_findings(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("title"), "user_id").agg(F.min("event_id").alias("event_id"))


@query("finding_node_counts", FX + ", f AS (SELECT 'orders/' || (1990 + user_id % 10) || '.ts' AS path FROM events WHERE event_type = 'error'), n AS (SELECT path, count(*) AS nodes FROM fx_nodes WHERE path IS NOT NULL GROUP BY 1) SELECT f.path, count(*) AS findings, coalesce(max(nodes), 0) AS nodes FROM f LEFT JOIN n USING (path) GROUP BY 1")
def finding_node_counts(spark, d):
    f = table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("orders/"), (F.col("user_id") % 10 + 1990).cast("string"), F.lit(".ts")).alias("path"))
    f = f.groupBy("path").agg(F.count(F.lit(1)).alias("findings"))
    n = nodes(spark, d).filter("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("nodes"))
    return f.join(n, "path", "left").select("path", "findings", F.coalesce("nodes", F.lit(0)).alias("nodes"))


# --- admission and jobs ----------------------------------------------------------------------

MANIFEST = "SELECT l_suppkey AS snapshot, printf('%08d-%d', l_orderkey, l_linenumber) AS path, (l_quantity * 100)::BIGINT AS size, l_returnflag <> 'R' AS ok FROM lineitem"


def manifest(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("snapshot"), F.format_string("%08d-%d", "l_orderkey", "l_linenumber").alias("path"), (F.col("l_quantity") * 100).cast("long").alias("size"), (F.col("l_returnflag") != "R").alias("ok"))


@query("coverage_rollup", f"SELECT snapshot, count(*) AS discovered, count(*) FILTER (ok) AS analyzed, sum(size)::BIGINT AS bytes, coalesce(sum(size) FILTER (ok), 0)::BIGINT AS analyzed_bytes FROM ({MANIFEST}) GROUP BY snapshot")
def coverage_rollup(spark, d):
    return manifest(spark, d).groupBy("snapshot").agg(F.count(F.lit(1)).alias("discovered"), F.count_if("ok").alias("analyzed"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("size"))), F.lit(0)).alias("analyzed_bytes"))


@query("admission_running_count", f"""WITH m AS ({MANIFEST}), r AS (SELECT *, sum(CASE WHEN ok AND size <= 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY snapshot ORDER BY path ROWS UNBOUNDED PRECEDING) AS seen FROM m)
SELECT snapshot, path, CASE WHEN NOT ok THEN 'kind' WHEN size > 4000 THEN 'file-size-limit' WHEN seen > 100 THEN 'analyzed-file-limit' END AS reason FROM r""")
def admission_running_count(spark, d):
    return R.admission(manifest(spark, d), 100, 4000, ["snapshot"]).select("snapshot", "path", "reason")


@query("admission_greedy", f"""WITH RECURSIVE m AS (SELECT snapshot, path, size, row_number() OVER (PARTITION BY snapshot ORDER BY path) AS r FROM ({MANIFEST}) WHERE ok),
w AS (SELECT snapshot, path, r, size <= 500000 AS taken, CASE WHEN size <= 500000 THEN size ELSE 0 END AS acc FROM m WHERE r = 1
UNION ALL SELECT m.snapshot, m.path, m.r, acc + size <= 500000, CASE WHEN acc + size <= 500000 THEN acc + size ELSE acc END FROM w JOIN m ON m.snapshot = w.snapshot AND m.r = w.r + 1)
SELECT snapshot, path, taken FROM w""")
def admission_greedy(spark, d):
    return R.greedy_budget(manifest(spark, d).filter("ok"), "snapshot", 500_000)


@query("batch_assignment", f"SELECT snapshot, path, ((row_number() OVER (PARTITION BY snapshot ORDER BY path) - 1) // 10)::BIGINT AS batch FROM ({MANIFEST}) WHERE ok")
def batch_assignment(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("snapshot").orderBy("path"))
    return manifest(spark, d).filter("ok").select("snapshot", "path", F.floor((n - 1) / 10).alias("batch"))


@query("latest_job_state", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS state, count(*) AS moves FROM events GROUP BY 1")
def latest_job_state(spark, d):
    e = table(spark, d, "events")
    moves = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("moves"))
    return M.latest(e.select("user_id", "event_id", "event_type"), "user_id", ["event_id"]).join(moves, "user_id").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), "moves")


@query("idempotent_create", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1, 2")
def idempotent_create(spark, d):
    there = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(there, "user_id", "left_anti").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("usage_windows", "SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY 1, 2")
def usage_windows(spark, d):
    return J.usage_windows(table(spark, d, "events"))


@query("pr_input_parse", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'deleted' WHEN event_type = 'signup' THEN 'added' ELSE 'modified' END AS status, 'src/' || user_id || '.ts' AS path FROM events""")
def pr_input_parse(spark, d):
    """Lines such as '- path' and '+ path' to changes."""
    mark = F.when(F.col("event_type") == "error", "- ").when(F.col("event_type") == "signup", "+ ").otherwise("")
    raw = F.concat(F.lit(" "), mark, F.lit("src/"), F.col("user_id").cast("string"), F.lit(".ts "))
    line = F.trim(raw)
    status = F.when(line.startswith("-"), "deleted").when(line.startswith("+"), "added").otherwise("modified")
    return table(spark, d, "events").select("event_id", status.alias("status"), F.trim(F.regexp_replace(line, r"\A[+-]\s*", "")).alias("path"))
