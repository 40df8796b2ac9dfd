"""Queries over the graph projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.order import order_key
from graphloom.operators import contracts as C
from graphloom.operators import graph as G
from graphloom.operators import reports as R
from graphloom.operators.extract import SUPPORTED
from graphloom.operators.ranks import RankIndex
from graphloom.plans.registry import query
from graphloom.sources.fixture import SQL as FX
from graphloom.sources.fixture import edges, ident, nodes, table
from graphloom.sources.records import FILES as FILES_OF
from graphloom.sources.records import LINES, REPOSITORY_DIAGNOSTICS

#: File edges in SQL, as several checks need them.
FILES = FX + """,
fe AS (SELECT a.path AS from_path, b.path AS to_path, e.kind FROM fx_edges e JOIN fx_nodes a ON e.src = a.id JOIN fx_nodes b ON e.dst = b.id
       WHERE e.kind NOT IN ('contains', 'declares') AND a.path <> b.path)"""
START, FAR = "file:part/1", "file:nation/3"
PART = "part"


@query("graph_search", FX + " SELECT id, kind, name FROM fx_nodes WHERE kind IN ('file', 'symbol') AND contains(lower(concat_ws(chr(0), id, name, kind, path, symbol_kind, method)), 'nation_1') ORDER BY id LIMIT 50")
def graph_search(spark, d):
    return G.search(nodes(spark, d), "Nation_1", ("file", "symbol"), max_results=50).select("id", "kind", "name")


@query("graph_node", FX + " SELECT id, kind, name, path FROM fx_nodes WHERE id = 'file:nation/3'")
def graph_node(spark, d):
    return nodes(spark, d).filter(F.col("id") == FAR).select("id", "kind", "name", "path")


@query("graph_neighbors", FX + " SELECT src, dst, kind, CASE WHEN src = 'file:nation/3' THEN dst ELSE src END AS other FROM fx_edges WHERE (src = 'file:nation/3' OR dst = 'file:nation/3') AND kind IN ('contains', 'declares') ORDER BY src, dst, kind LIMIT 50")
def graph_neighbors(spark, d):
    return G.neighbors(edges(spark, d), FAR, "both", ("contains", "declares"), 0, 50)


@query("graph_explain", FX + " SELECT src, dst, kind, CASE WHEN src = 'file:part/1' THEN dst ELSE src END AS other FROM fx_edges WHERE src = 'file:part/1' OR dst = 'file:part/1'")
def graph_explain(spark, d):
    return G.neighbors(edges(spark, d), START)


@query("cursor_page", FX + " SELECT id, name FROM fx_nodes WHERE kind = 'schema' AND contains(lower(concat_ws(chr(0), id, name, kind, path, symbol_kind, method)), 'supplier') ORDER BY id LIMIT 20 OFFSET 40")
def cursor_page(spark, d):
    return G.search(nodes(spark, d), "supplier", ("schema",), 40, 20).select("id", "name")


@query("graph_impact", FX + """,
walk(id, depth) AS (SELECT 'file:nation/3', 0 UNION SELECT e.src, depth + 1 FROM walk JOIN fx_edges e ON e.dst = walk.id WHERE depth < 3 AND e.kind <> 'depends-on')
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id""")
def graph_impact(spark, d):
    return G.impact(edges(spark, d).filter("kind <> 'depends-on'"), FAR, "incoming", None, 3)


@query("graph_shortest_path", FX + """,
walk(id, depth) AS (SELECT 'file:part/1', 0 UNION SELECT e.dst, depth + 1 FROM walk JOIN fx_edges e ON e.src = walk.id WHERE depth < 2),
s AS (SELECT min(e.dst) AS n FROM walk JOIN fx_edges e ON e.src = walk.id WHERE depth = 1)
SELECT 0 AS step, 'file:part/1' AS id UNION ALL
SELECT 1, min(a.dst) FROM fx_edges a JOIN fx_edges b ON a.dst = b.src WHERE a.src = 'file:part/1' AND b.dst = (SELECT n FROM s)
UNION ALL SELECT 2, n FROM s""")
def graph_shortest_path(spark, d):
    e = edges(spark, d)
    far = e.filter(F.col("src") == START).select(F.col("dst").alias("src")).join(e, "src").agg(F.min("dst")).first()[0]
    return G.shortest_path(e, START, far or START, "outgoing", None, 4)


RANKED = FX + """, re AS (SELECT *, row_number() OVER (ORDER BY src, dst, kind) - 1 AS pos FROM fx_edges), rn AS (SELECT *, row_number() OVER (ORDER BY id || '"') - 1 AS pos FROM fx_nodes),
tot AS (SELECT (SELECT count(*) FROM fx_edges) AS e, (SELECT count(*) FROM fx_nodes) AS n)"""


def walked(of: str, start: str, depth: int, cost: int, results: int) -> str:
    """CTEs of a walk in both directions over ranked edges (of) under its budgets, level by level: seen{k} has the nodes
    met up to level k with the scan and the edge that met each; end{k} what is spent and whether it goes on.  The node
    of rank r in a level scans the edge at pos as number base + r * edges + pos."""
    out = [f"""
hops AS (SELECT src AS from_id, dst AS to_id, pos FROM {of} UNION ALL SELECT dst, src, pos FROM {of} WHERE src <> dst), edges_n AS (SELECT count(*) AS e FROM {of}),
front0 AS (SELECT '{start}' AS id, 0::BIGINT AS rank), seen0 AS (SELECT '{start}' AS id, -1::BIGINT AS s, 0 AS depth, NULL::BIGINT AS pos),
end0 AS (SELECT 0::BIGINT AS base, 1::BIGINT AS size, true AS goes, 0::BIGINT AS cost, NULL::VARCHAR AS reason)"""]
    for k in range(1, depth + 1):
        out.append(f"""
met{k} AS (SELECT to_id AS id, min(base + rank * e + pos) AS s, arg_min(pos, base + rank * e + pos) AS pos FROM front{k - 1} JOIN hops ON from_id = id, end{k - 1}, edges_n
  WHERE goes AND base + rank * e + pos < {cost} AND to_id NOT IN (SELECT id FROM seen{k - 1}) GROUP BY to_id),
rank{k} AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS rank FROM met{k}),
over{k} AS (SELECT min(s) AS s FROM rank{k}, end{k - 1} WHERE rank = {results} - size),
kept{k} AS (SELECT rank{k}.* FROM rank{k}, end{k - 1} WHERE rank < {results} - size),
front{k} AS (SELECT id, rank FROM kept{k}), seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT id, s, {k}, pos FROM kept{k}),
full{k} AS (SELECT end{k - 1}.*, coalesce(over{k}.s + 1, base + (SELECT count(*) FROM front{k - 1}) * e) AS f, over{k}.s IS NOT NULL AS ran_over FROM end{k - 1}, over{k}, edges_n),
end{k} AS (SELECT f AS base, (SELECT count(*) FROM seen{k}) AS size, goes AND f <= {cost} AND NOT ran_over AND (SELECT count(*) FROM front{k}) > 0 AS goes,
  CASE WHEN goes THEN least(f, {cost}) ELSE cost END AS cost, CASE WHEN NOT goes THEN reason WHEN f > {cost} THEN 'cost' WHEN ran_over THEN 'results' END AS reason FROM full{k})""")
    return ",".join(out)


#: The whole graph under the default budget: there are more edges than it has scans, but on the smallest tables.
WHOLE = RANKED + "," + walked("re", "file:nation/3", 4, 10_000, 50)
#: Kinds of edges between places and what is in them: few enough that a walk gets beyond its first level.
PLACES = ("contains", "declares", "depends-on")
PLACE_WALK = FX + """, pe AS (SELECT *, row_number() OVER (ORDER BY src, dst, kind) - 1 AS pos FROM fx_edges WHERE kind IN ('contains', 'declares', 'depends-on')),""" + walked("pe", "file:nation/3", 4, 10_000, 500)


@query("graph_impact_budget", WHOLE + " SELECT id, depth FROM seen4")
def graph_impact_budget(spark, d):
    """An impact over the whole graph under the default budget of scans."""
    return G.budgeted_levels(edges(spark, d), FAR, "both", None, 4, max_results=50)[0].select("id", "depth")


@query("graph_impact_levels", PLACE_WALK + " SELECT seen4.id, seen4.depth, pe.src, pe.dst, pe.kind, end4.cost, end4.reason FROM end4, seen4 LEFT JOIN pe USING (pos)")
def graph_impact_levels(spark, d):
    """An impact over places and what is in them: levels, the edge that met each node, cost, and why it stopped, which is
    within the second level or later."""
    seen, first, meta = G.budgeted_levels(edges(spark, d).filter(F.col("kind").isin(*PLACES)), FAR, "both", None, 4, max_results=500)
    out = seen.select("id", "depth", "pos").join(first.select("pos", "src", "dst", "kind"), "pos", "left").drop("pos")
    return out.withColumn("cost", F.lit(meta["cost"]).cast("long")).withColumn("reason", F.lit(meta["truncationReason"]).cast("string"))


@query("impact_tree", WHOLE + " SELECT src, dst, kind FROM seen4 JOIN re USING (pos)")
def impact_tree(spark, d):
    """Edges by which a bounded impact met its nodes."""
    return G.answer_impact(nodes(spark, d), edges(spark, d), FAR, "both", None, 4)[1]


NEAR = """hit AS (SELECT *, row_number() OVER (ORDER BY pos) AS r FROM re WHERE pos < 10000 AND (src = 'file:nation/3' OR dst = 'file:nation/3') AND kind IN ('contains', 'declares')),
page AS (SELECT * FROM hit WHERE r > 1 AND r <= 8), ends AS (SELECT src AS id FROM page UNION SELECT dst FROM page UNION SELECT 'file:nation/3')"""


@query("neighbor_nodes", RANKED + f", {NEAR} SELECT id, kind, name FROM fx_nodes WHERE id IN (SELECT id FROM ends)")
def neighbor_nodes(spark, d):
    """Nodes of a page of neighbours, the node itself among them."""
    return G.answer_neighbors(nodes(spark, d), edges(spark, d), FAR, "both", ("contains", "declares"), 1, max_results=7)[0].select("id", "kind", "name")


@query("query_envelope", WHOLE + f""", {NEAR},
sm AS (SELECT pos, row_number() OVER (ORDER BY pos) AS r FROM rn WHERE pos < 10000 AND kind IN ('file', 'symbol') AND contains(lower(concat_ws(chr(0), id, name, kind, path, symbol_kind, method)), 'nation_1')),
so AS (SELECT min(pos) FILTER (r = 8) AS over, count(*) FILTER (r > 2 AND r <= 7) AS n FROM sm), no AS (SELECT min(pos) FILTER (r = 9) AS over FROM hit),
xm AS (SELECT *, row_number() OVER (ORDER BY pos) AS r FROM re WHERE pos < 10000 AND (src = 'file:part/1' OR dst = 'file:part/1')), xo AS (SELECT min(pos) FILTER (r = 51) AS over, count(*) FILTER (r <= 50) AS n FROM xm),
xe AS (SELECT src AS id FROM xm WHERE r <= 50 UNION SELECT dst FROM xm WHERE r <= 50 UNION SELECT 'file:part/1'), pt AS (SELECT min_by(dst, pos) AS t, min(pos) AS pos FROM re WHERE src = 'file:part/1' AND dst = (SELECT min(dst) FROM fx_edges WHERE src = 'file:part/1'))
SELECT 'search' AS query, n AS nodes, 0::BIGINT AS edges, NULL::VARCHAR AS path, coalesce(over + 1, least((SELECT n FROM tot), 10000)) AS cost, over IS NOT NULL OR (SELECT n FROM tot) > 10000 AS truncated, CASE WHEN over IS NOT NULL THEN 'results' WHEN (SELECT n FROM tot) > 10000 THEN 'cost' END AS truncation_reason, CASE WHEN over IS NOT NULL THEN 7 END::BIGINT AS next_cursor FROM so
UNION ALL SELECT 'node', 1, 0, NULL, 1, false, NULL, NULL
UNION ALL SELECT 'neighbors', (SELECT count(*) FROM fx_nodes WHERE id IN (SELECT id FROM ends)), (SELECT count(*) FROM page), NULL, coalesce(over + 1, least((SELECT e FROM tot), 10000)), over IS NOT NULL OR (SELECT e FROM tot) > 10000, CASE WHEN over IS NOT NULL THEN 'results' WHEN (SELECT e FROM tot) > 10000 THEN 'cost' END, CASE WHEN over IS NOT NULL THEN 8 END FROM no
UNION ALL SELECT 'explain', (SELECT count(*) FROM fx_nodes WHERE id IN (SELECT id FROM xe)), n, NULL, coalesce(over + 1, least((SELECT e FROM tot), 10000)), over IS NOT NULL OR (SELECT e FROM tot) > 10000, CASE WHEN over IS NOT NULL THEN 'results' WHEN (SELECT e FROM tot) > 10000 THEN 'cost' END, CASE WHEN over IS NOT NULL THEN 50 END FROM xo
UNION ALL SELECT 'impact', size, size - 1, NULL, cost, reason IS NOT NULL, reason, NULL FROM end4
UNION ALL SELECT 'shortestPath', 2, 1, 'file:part/1 > ' || t, pos + 1, false, NULL, NULL FROM pt""")
def query_envelope(spark, d):
    """Envelopes of every kind of query under its budget: counts, path, cost, truncation and next cursor."""
    n, e = nodes(spark, d), edges(spark, d)
    far = e.filter(F.col("src") == START).agg(F.min("dst")).first()[0]
    out = [
        G.answer_search(n, "Nation_1", ("file", "symbol"), 2, max_results=5)[-1],
        G.answer_node(n, FAR)[-1],
        G.answer_neighbors(n, e, FAR, "both", ("contains", "declares"), 1, max_results=7)[-1],
        G.answer_explain(n, e, START)[-1],
        G.answer_impact(n, e, FAR, "both", None, 4)[-1],
        G.answer_path(n, e, START, far, "outgoing", None, 4)[-1],
    ]
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows.withColumn("path", F.when(F.col("path").isNotNull(), F.array_join("path", " > ")))


@query("hub_modules", FILES + """, f AS (SELECT from_path AS path, 0 AS i, 1 AS o FROM fe UNION ALL SELECT to_path, 1, 0 FROM fe)
SELECT path, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, (sum(i) + sum(o))::BIGINT AS total FROM f GROUP BY path ORDER BY total DESC, path LIMIT 10""")
def hub_modules(spark, d):
    return R.hub_modules(nodes(spark, d), edges(spark, d))


@query("dir_flows", FILES + """ SELECT split_part(from_path, '/', 1) AS from_dir, split_part(to_path, '/', 1) AS to_dir, count(*) AS edges FROM fe
WHERE split_part(from_path, '/', 1) <> split_part(to_path, '/', 1) GROUP BY 1, 2 ORDER BY edges DESC, 1, 2 LIMIT 15""")
def dir_flows(spark, d):
    return R.directory_flows(nodes(spark, d), edges(spark, d))


@query("top_directories", FILES + """,
c AS (SELECT split_part(from_path, '/', 1) AS f, split_part(to_path, '/', 1) AS t FROM fe WHERE split_part(from_path, '/', 1) <> split_part(to_path, '/', 1)),
n AS (SELECT split_part(path, '/', 1) AS dir, count(DISTINCT path) AS files FROM fx_nodes WHERE path IS NOT NULL GROUP BY 1)
SELECT dir, files, (SELECT count(*) FROM c WHERE t = dir) AS fan_in, (SELECT count(*) FROM c WHERE f = dir) AS fan_out FROM n""")
def top_directories(spark, d):
    """Top directories with their files, and the edges between files that enter and leave each."""
    return R.directory_summary(nodes(spark, d), edges(spark, d))


@query("dir_file_counts", FX + " SELECT split_part(path, '/', 1) AS dir, count(DISTINCT path) AS files FROM fx_nodes WHERE path IS NOT NULL GROUP BY 1")
def dir_file_counts(spark, d):
    return R.directory_files(nodes(spark, d))


@query("file_relationships", FX + """, own AS (SELECT id FROM fx_nodes WHERE path = 'geo/EUROPE/NATION_3.ts'),
r AS (SELECT 'outgoing' AS direction, kind, dst AS other FROM fx_edges WHERE src IN (SELECT id FROM own) AND dst NOT IN (SELECT id FROM own) AND kind NOT IN ('contains', 'declares')
      UNION ALL SELECT 'incoming', kind, src FROM fx_edges WHERE dst IN (SELECT id FROM own) AND src NOT IN (SELECT id FROM own) AND kind NOT IN ('contains', 'declares'))
SELECT DISTINCT direction, r.kind, other, name AS other_name, path AS other_path FROM r JOIN fx_nodes n ON n.id = other""")
def file_relationships(spark, d):
    return R.file_relationships(nodes(spark, d), edges(spark, d), "geo/EUROPE/NATION_3.ts")


DETAILED = f"""SELECT edge_id AS id, src, dst, kind, start_line AS line FROM ({LINES.sql})"""


@query("file_details", FX + f""", e AS ({DETAILED}), own AS (SELECT id FROM fx_nodes WHERE path = 'orders/1995.ts'),
r AS (SELECT 'relationship' AS what, id, kind, CASE WHEN src IN (SELECT id FROM own) THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN src IN (SELECT id FROM own) THEN dst ELSE src END AS other, line
      FROM e WHERE kind NOT IN ('contains', 'declares') AND (src IN (SELECT id FROM own)) <> (dst IN (SELECT id FROM own))),
x AS (SELECT what, r.id, r.kind, direction, name, path, line FROM r JOIN fx_nodes AS n ON n.id = other
      UNION ALL SELECT kind, id, kind, NULL, name, path, NULL FROM fx_nodes WHERE path = 'orders/1995.ts' AND kind IN ('symbol', 'route'))
SELECT row_number() OVER (ORDER BY CASE what WHEN 'symbol' THEN 0 WHEN 'route' THEN 1 ELSE 2 END, CASE WHEN what = 'relationship' THEN concat_ws(chr(0), direction, kind, coalesce(path, ''), name, id) END NULLS FIRST, id) AS place,
       what, id, kind, direction, name, path, line FROM x""")
def file_details(spark, d):
    """Symbols, routes and relationships of a file, each edge with its id and first line."""
    e = LINES.read(spark, d).select(F.col("edge_id").alias("id"), "src", "dst", "kind", F.col("start_line").alias("line"))
    return R.file_details(nodes(spark, d), e, "orders/1995.ts")


@query("locale_order", """
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END || ' ' || (p_partkey % 3) AS name FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY lower(name), translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'), p_partkey) - 1 AS place FROM t""")
def locale_order(spark, d):
    """Names in a dictionary's order, capitals beside small letters; places by ranges."""
    big = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    name = F.concat(F.when(F.col("p_size") % 2 == 0, big).otherwise(F.col("p_name")), F.lit(" "), (F.col("p_partkey") % 3).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"))
    index = RankIndex(rows, [*order_key("name", mode="locale"), F.col("p_partkey")])
    return index.page().select("p_partkey", F.col("pos").alias("place"))


@query("related_nodes", FX + " SELECT id, kind, name FROM fx_nodes WHERE path = 'geo/EUROPE/NATION_3.ts'")
def related_nodes(spark, d):
    return nodes(spark, d).filter(F.col("path") == "geo/EUROPE/NATION_3.ts").select("id", "kind", "name")


@query("impacted_files", FX + """,
b AS (SELECT DISTINCT x.path AS f, y.path AS t, e.kind FROM fx_edges e JOIN fx_nodes x ON e.src = x.id JOIN fx_nodes y ON e.dst = y.id
      WHERE e.kind IN ('imports', 'requires', 'references', 'calls', 'tests') AND x.path <> y.path),
walk(path, depth) AS (SELECT 'geo/EUROPE/NATION_3.ts', 0 UNION SELECT b.f, depth + 1 FROM walk JOIN b ON b.t = walk.path WHERE depth < 3),
m AS (SELECT path, min(depth) AS depth FROM walk GROUP BY path)
SELECT m.path, m.depth::INTEGER AS depth, string_agg(DISTINCT b.kind, ',' ORDER BY b.kind) AS kinds FROM m JOIN b ON b.f = m.path JOIN m AS n ON n.path = b.t AND n.depth = m.depth - 1
WHERE m.depth > 0 GROUP BY 1, 2 ORDER BY 2, 1 LIMIT 50""")
def impacted_files(spark, d):
    return R.impacted_files(nodes(spark, d), edges(spark, d), "geo/EUROPE/NATION_3.ts")


def changes(spark, d):
    """Changed files: those of all parts that labels name, with a status from their marks."""
    l, p = table(spark, d, "labels"), table(spark, d, "part")
    path = F.concat(F.lit("catalog/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".js"))
    status = F.when(F.col("toxic") == 1, "deleted").when(F.col("quality") == 1, "modified").otherwise("added")
    return l.join(p, F.col("doc_id") == F.col("p_partkey")).select(F.col("doc_id").alias("place"), path.alias("path"), status.alias("status"))


CHANGES = FX + """,
ch AS (SELECT 'catalog/' || p_brand || '/' || p_type || '/' || p_partkey || '.js' AS path, CASE WHEN toxic = 1 THEN 'deleted' WHEN quality = 1 THEN 'modified' ELSE 'added' END AS status, doc_id AS place
       FROM labels JOIN part ON doc_id = p_partkey),
near AS (SELECT src, dst FROM fx_edges WHERE kind NOT IN ('contains', 'declares')),
walk(id, depth) AS (SELECT id, 0 FROM fx_nodes WHERE path IN (SELECT path FROM ch) UNION SELECT near.src, depth + 1 FROM walk JOIN near ON near.dst = walk.id WHERE depth < 4),
reached AS (SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id)"""


@query("pr_direct_nodes", CHANGES + " SELECT id, kind, path FROM fx_nodes WHERE path IN (SELECT path FROM ch)")
def pr_direct_nodes(spark, d):
    return nodes(spark, d).join(changes(spark, d).select("path").distinct(), "path", "left_semi").select("id", "kind", "path")


@query("pr_transitive", CHANGES + " SELECT id, depth FROM reached WHERE depth > 0")
def pr_transitive(spark, d):
    return R.change_impact(nodes(spark, d), edges(spark, d), changes(spark, d)).filter("depth > 0")


@query("pr_affected", CHANGES + """ SELECT 'route' AS what, id, name, path FROM fx_nodes JOIN reached USING (id) WHERE kind = 'route' UNION ALL SELECT 'schema', id, name, path FROM fx_nodes JOIN reached USING (id) WHERE kind = 'schema'
UNION ALL SELECT 'test', id, name, path FROM fx_nodes WHERE (kind = 'symbol' AND contains(lower(name), 'test')) OR (contains(path, 'test') AND id IN (SELECT id FROM reached))
UNION ALL SELECT 'export', id, name, path FROM fx_nodes JOIN reached USING (id) WHERE depth = 0 AND kind = 'symbol' AND exported""")
def pr_affected(spark, d):
    return R.affected(nodes(spark, d), R.change_impact(nodes(spark, d), edges(spark, d), changes(spark, d)))


def first_steps(depth: int) -> str:
    """CTEs of the nodes that each level of a change set's walk meets first: trail{k} has each node's trail, the list of
    its steps, whose order is that in which a queue would meet nodes."""
    out = ["t0 AS (SELECT id, [id] AS trail, NULL::VARCHAR AS via, 0 AS depth FROM fx_nodes WHERE path IN (SELECT path FROM ch))"]
    near = "(SELECT src, dst, min(kind) AS kind FROM fx_edges WHERE kind NOT IN ('contains', 'declares') GROUP BY src, dst)"
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT id FROM t{j}" for j in range(k))
        out.append(f"""c{k} AS (SELECT src AS id, list_append(trail, src) AS trail, e.kind AS via FROM t{k - 1} JOIN {near} AS e ON e.dst = t{k - 1}.id WHERE src NOT IN ({before})),
t{k} AS (SELECT id, min(trail) AS trail, arg_min(via, trail) AS via, {k} AS depth FROM c{k} GROUP BY id)""")
    return ",\n".join(out)


@query("pr_transitive_impacts", CHANGES + "," + first_steps(4) + """
SELECT id AS node_id, kind, name, path, t.depth AS distance, via AS via_edge_kind FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) AS t JOIN fx_nodes USING (id)""")
def pr_transitive_impacts(spark, d):
    """Nodes that a change set reaches, with the kind of the edge by which each is met first."""
    return R.transitive_impacts(nodes(spark, d), edges(spark, d), changes(spark, d))


RISK = CHANGES + """,
a AS (SELECT count(*) FILTER (depth = 0 AND kind = 'symbol' AND coalesce(exported, false)) AS exports, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (depth > 0) AS transitive FROM reached JOIN fx_nodes USING (id)),
f AS (SELECT count(*) AS files, count(*) FILTER (status = 'deleted') AS deletions FROM ch),
s AS (SELECT exports, routes, transitive, files, deletions, least(100, CASE WHEN files > 15 THEN 25 WHEN files > 5 THEN 15 ELSE 0 END + least(10 * deletions, 30) + least(10 * exports, 30) + least(15 * routes, 30) + CASE WHEN transitive > 20 THEN 20 WHEN transitive > 5 THEN 10 ELSE 0 END)::BIGINT AS score FROM a, f),
rs AS (SELECT *, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level FROM s)"""


@query("pr_summary", RISK + """ SELECT printf('PR touches %d file(s) impacting %d direct node(s) and %d transitive node(s). %d route(s) and %d public export(s) affected. Risk score: %d/100 (%s).', files, (SELECT count(*) FROM reached WHERE depth = 0), transitive, routes, exports, score, upper(level)) AS summary FROM rs""")
def pr_summary(spark, d):
    n, c = nodes(spark, d), changes(spark, d)
    return R.change_summary(n, c, R.change_impact(n, edges(spark, d), c))


@query("pr_risk_factors", RISK + """,
gone AS (SELECT string_agg(path, ', ' ORDER BY place, path) AS paths FROM (SELECT * FROM ch WHERE status = 'deleted' ORDER BY place, path LIMIT 3)),
x AS (SELECT 1 AS place, CASE WHEN files > 15 THEN 'Large PR Scope' WHEN files > 5 THEN 'Moderate PR Scope' END AS title, CASE WHEN files > 15 THEN 25 ELSE 15 END AS score, files || ' files modified in PR' AS reason FROM rs
UNION ALL SELECT 2, CASE WHEN deletions > 0 THEN 'File Deletions' END, least(10 * deletions, 30), deletions || ' file(s) deleted: ' || paths FROM rs, gone
UNION ALL SELECT 3, CASE WHEN exports > 0 THEN 'Exported Interface Changes' END, least(10 * exports, 30), exports || ' exported symbol(s) modified' FROM rs
UNION ALL SELECT 4, CASE WHEN routes > 0 THEN 'API Endpoint Impact' END, least(15 * routes, 30), routes || ' HTTP route(s) in blast radius' FROM rs
UNION ALL SELECT 5, CASE WHEN transitive > 20 THEN 'High Transitive Blast Radius' WHEN transitive > 5 THEN 'Moderate Blast Radius' END, CASE WHEN transitive > 20 THEN 20 ELSE 10 END, transitive || ' dependent graph nodes impacted' FROM rs)
SELECT place, title, score::BIGINT AS score, reason FROM x WHERE title IS NOT NULL""")
def pr_risk_factors(spark, d):
    """What makes up a change set's risk, each with its score and reason."""
    c = changes(spark, d)
    return R.risk_factors(nodes(spark, d), c, R.change_impact(nodes(spark, d), edges(spark, d), c))


@query("pr_risk", RISK + " SELECT * FROM rs")
def pr_risk(spark, d):
    c = changes(spark, d)
    return R.change_risk(nodes(spark, d), c, R.change_impact(nodes(spark, d), edges(spark, d), c))


def versions(df, column: str):
    """Base and target of a table's diff: by key, without multiples of 5 and of 7."""
    key = F.regexp_extract(F.col(column), r"(\d+)$", 1).cast("long")
    return df.filter(key % 5 != 0), df.filter(key % 7 != 0)


BOTH = FX + """,
base AS (SELECT * FROM fx_nodes WHERE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 5 <> 0), target AS (SELECT * FROM fx_nodes WHERE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 7 <> 0),
kb AS (SELECT DISTINCT kind, coalesce(path, '') AS path, name FROM base), kt AS (SELECT DISTINCT kind, coalesce(path, '') AS path, name FROM target),
dn AS (SELECT 'added' AS change, * FROM (SELECT * FROM kt EXCEPT SELECT * FROM kb) UNION ALL SELECT 'removed', * FROM (SELECT * FROM kb EXCEPT SELECT * FROM kt)),
eb AS (SELECT * FROM fx_edges WHERE regexp_extract(src, '(\\d+)$', 1)::BIGINT % 5 <> 0), et AS (SELECT * FROM fx_edges WHERE regexp_extract(src, '(\\d+)$', 1)::BIGINT % 7 <> 0),
de AS (SELECT 'added' AS change, * FROM (SELECT * FROM et EXCEPT SELECT * FROM eb) UNION ALL SELECT 'removed', * FROM (SELECT * FROM eb EXCEPT SELECT * FROM et))""".replace("\\\\", "\\")


@query("diff_nodes", BOTH + " SELECT change, kind, path, name FROM dn")
def diff_nodes(spark, d):
    return R.diff_nodes(*versions(nodes(spark, d), "id"))


@query("diff_edges", BOTH + " SELECT change, src, dst, kind FROM de")
def diff_edges(spark, d):
    return R.diff_edges(*versions(edges(spark, d), "src"))


@query("diff_summary", BOTH + """, m AS (SELECT count(*) AS n FROM (SELECT * FROM kb WHERE kind = 'file' INTERSECT SELECT * FROM kt)),
eb2 AS (SELECT count(*) AS n FROM et WHERE (src, dst, kind) NOT IN (SELECT src, dst, kind FROM eb)), et2 AS (SELECT count(*) AS n FROM eb WHERE (src, dst, kind) NOT IN (SELECT src, dst, kind FROM et))
SELECT count(*) FILTER (kind = 'file' AND change = 'added') AS added_files, count(*) FILTER (kind = 'file' AND change = 'removed') AS removed_files, (SELECT n FROM m) AS modified_files, count(*) FILTER (kind = 'symbol' AND change = 'added') AS added_symbols, count(*) FILTER (kind = 'symbol' AND change = 'removed') AS removed_symbols,
count(*) FILTER (kind = 'route' AND change = 'added') AS added_routes, count(*) FILTER (kind = 'route' AND change = 'removed') AS removed_routes, (SELECT n FROM eb2) AS added_edges, (SELECT n FROM et2) AS removed_edges FROM dn""")
def diff_summary(spark, d):
    """The nine counters of a diff."""
    return R.diff_summary(*versions(nodes(spark, d), "id"), *versions(edges(spark, d), "src"))


@query("diff_warnings", BOTH + """, gone AS (SELECT kind, coalesce(path, '') AS path, name, max_by(coalesce(exported, false), id) AS exported FROM base WHERE kind IN ('symbol', 'route') AND (kind, coalesce(path, ''), name) NOT IN (SELECT kind, path, name FROM kt) GROUP BY 1, 2, 3)
SELECT kind, name, CASE WHEN kind = 'route' THEN 'Route endpoint `' || name || '` was removed.' ELSE 'Exported symbol `' || name || '` in `' || CASE WHEN path = '' THEN 'unknown' ELSE path END || '` was removed.' END AS warning FROM gone WHERE kind = 'route' OR exported""")
def diff_warnings(spark, d):
    return R.breaking_warnings(*versions(nodes(spark, d), "id"))


@query("external_dependencies", FX + " SELECT DISTINCT n.path AS file, p.name AS package FROM fx_edges e JOIN fx_nodes n ON e.src = n.id JOIN fx_nodes p ON e.dst = p.id WHERE n.kind = 'file' AND p.kind = 'package'")
def external_dependencies(spark, d):
    n = nodes(spark, d)
    f = n.filter("kind = 'file'").select(F.col("id").alias("src"), F.col("path").alias("file"))
    p = n.filter("kind = 'package'").select(F.col("id").alias("dst"), F.col("name").alias("package"))
    return edges(spark, d).join(f, "src").join(p, "dst").select("file", "package").distinct()


@query("dangling_edges", FX + ", kept AS (SELECT id FROM fx_nodes WHERE kind <> 'schema') SELECT src, dst, kind FROM fx_edges WHERE src NOT IN (SELECT id FROM kept) OR dst NOT IN (SELECT id FROM kept)")
def dangling_edges(spark, d):
    """Edges without an end, in the graph without its schema nodes."""
    kept = nodes(spark, d).filter("kind <> 'schema'").select("id")
    e = edges(spark, d)
    no_src = e.join(kept.withColumnRenamed("id", "src"), "src", "left_anti")
    no_dst = e.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return no_src.unionByName(no_dst).select("src", "dst", "kind")


@query("duplicate_ids", FX + " SELECT id, count(*) AS n FROM (SELECT id FROM fx_nodes UNION ALL SELECT 'file:part/' || p_partkey FROM part WHERE p_size > 45 UNION ALL SELECT 'file:nation/' || s_nationkey FROM supplier) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    """Ids that two extractors gave, of the projected graph and one that repeats some of its files."""
    more = table(spark, d, "part").filter("p_size > 45").select(ident("file:part/", "p_partkey").alias("id")).unionByName(table(spark, d, "supplier").select(ident("file:nation/", "s_nationkey").alias("id")))
    return C.duplicates(nodes(spark, d).select("id").unionByName(more), "id")


LINE_EDGES = """SELECT 'route:order/' || l_orderkey AS src, 'file:part/' || l_partkey AS dst, 'references' AS kind, CASE WHEN l_returnflag = 'R' THEN 'INFERRED' ELSE 'EXTRACTED' END AS provenance, CASE WHEN l_returnflag = 'R' THEN round(1 - l_discount, 2) END AS confidence,
'edge:' || l_orderkey || ':' || l_linenumber AS id, l_shipdate::DATE::VARCHAR AS evidence FROM lineitem"""


def line_edges(spark, d):
    """An edge for each order line, with what it was found by; some say the same."""
    l = table(spark, d, "lineitem")
    ids = F.concat(F.lit("edge:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    inferred = F.col("l_returnflag") == "R"
    return l.select(ident("route:order/", "l_orderkey").alias("src"), ident("file:part/", "l_partkey").alias("dst"), F.lit("references").alias("kind"), F.when(inferred, "INFERRED").otherwise("EXTRACTED").alias("provenance"), F.when(inferred, F.round(1 - F.col("l_discount"), 2)).alias("confidence"), ids.alias("id"), F.array(F.col("l_shipdate").cast("date").cast("string")).alias("evidence"))


@query("merge_edges", f"SELECT src, dst, kind, provenance, confidence, min(id) AS id, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM ({LINE_EDGES}) GROUP BY ALL")
def merge_edges(spark, d):
    return R.merge_edges(line_edges(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


QUESTION = "Where is the nation_1 route of supplier handled?"
FACTS = FX + """, t AS (SELECT unnest(['nation_1', 'route', 'supplier', 'handled']) AS w),
h AS (SELECT id, kind, name, path, method, lower(concat_ws(' ', name, kind, path, symbol_kind, method)) AS hay FROM fx_nodes WHERE path IS NOT NULL),
s AS (SELECT id, kind, name, path, method, (SELECT count(*) FROM t WHERE contains(hay, w)) + CASE WHEN kind = 'route' THEN 100 ELSE 0 END AS score FROM h),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, name, id) AS place FROM s WHERE score > 0)"""


@query("qa_rank", FACTS + """ SELECT place::INTEGER AS place, 'citation-' || place AS citation, id, score::BIGINT AS score, path, CASE WHEN kind = 'route' THEN method ELSE kind END || ' ' || name || ' is declared in ' || path || '.' AS text FROM best WHERE place <= 10""")
def qa_rank(spark, d):
    return R.answer(nodes(spark, d), QUESTION)


@query("qa_confidence", FACTS + """ SELECT least(count(*), 10) AS facts, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) > 0 THEN 'medium' ELSE 'insufficient' END AS confidence, CASE WHEN count(*) = 0 THEN 'Indexed graph contains insufficient evidence to answer this question.' END AS unknown FROM best
UNION ALL SELECT 0, 'insufficient', 'Indexed graph contains insufficient evidence to answer this question.' WHERE NOT EXISTS (SELECT 1 FROM h WHERE contains(hay, 'unknowable'))""")
def qa_confidence(spark, d):
    """Confidence of an answer with facts and of one without."""
    n = nodes(spark, d)
    return R.answer_confidence(R.answer(n, QUESTION)).unionByName(R.answer_confidence(R.answer(n, "What is unknowable?")))


@query("question_tokens", r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_@./-]{3,}')) AS w, regexp_extract_all(lower(text), '[a-z0-9_@./-]{3,}') AS a FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(a[1:], lambda x, i: x NOT IN ('and', 'are', 'does', 'from', 'how', 'repository', 'the', 'this', 'what', 'where', 'which', 'with') AND NOT list_contains(a[1:i - 1], x))[1:12])) AS t FROM w)
SELECT conv_id, turn, array_to_string(t, ' ') AS tokens FROM k""")
def question_tokens(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(F.sort_array(R.question_tokens(F.col("text"))), " ").alias("tokens"))


LISTS = FX + """, el AS (SELECT DISTINCT a.path || ':' || e.dst || ':' || CASE e.kind WHEN 'requires' THEN 'require' ELSE 'import' END AS item, a.path AS p, e.dst AS t FROM fx_edges e JOIN fx_nodes a ON a.id = e.src WHERE e.kind IN ('imports', 'requires') AND a.kind = 'file' AND a.path IS NOT NULL),
x AS (SELECT 'edges' AS list, item FROM (SELECT item FROM el ORDER BY p, t LIMIT 800)
UNION ALL SELECT 'symbols', path || ':0000000001:' || name || ':' || symbol_kind FROM (SELECT * FROM fx_nodes WHERE kind = 'symbol' AND path IS NOT NULL ORDER BY path, name, symbol_kind LIMIT 1500)
UNION ALL SELECT 'routes', path || ':' || name || ':' || method FROM (SELECT * FROM fx_nodes WHERE kind = 'route' AND path IS NOT NULL ORDER BY path, name, method LIMIT 300)
UNION ALL SELECT DISTINCT 'dependencies', p.name FROM fx_edges e JOIN fx_nodes p ON p.id = e.dst WHERE p.kind = 'package' UNION ALL SELECT 'sources', path FROM fx_nodes WHERE kind = 'file' AND path IS NOT NULL)"""


@query("legacy_model", LISTS + " SELECT list, count(*) AS n, sha256(string_agg(item, chr(10) ORDER BY item)) AS digest FROM x WHERE list <> 'sources' GROUP BY list UNION ALL SELECT list, count(*), NULL FROM x WHERE list = 'sources' GROUP BY list")
def legacy_model(spark, d):
    """Every list of the compatibility model: its length, and a digest of its items where it has a largest length."""
    lists = R.legacy_lists(nodes(spark, d), edges(spark, d))
    out = None
    for name, items in lists.items():
        part = items.select(F.lit(name).alias("list"), "item")
        out = part if out is None else out.unionByName(part)
    bounded = F.when(F.col("list") != "sources", F.col("item"))
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(bounded)), "\n"), 256)
    return out.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("list") != "sources", digest).alias("digest"))


@query("mermaid_lines", FX + r""", e AS (SELECT *, row_number() OVER (ORDER BY src || dst || kind) AS n FROM (SELECT * FROM fx_edges WHERE kind NOT IN ('contains', 'declares') ORDER BY src, dst, kind LIMIT 50)),
b AS (SELECT src, dst, e.kind AS kind, n, a.name AS an, a.kind AS ak, z.name AS zn, z.kind AS zk FROM e JOIN fx_nodes a ON a.id = src JOIN fx_nodes z ON z.id = dst),
x AS (SELECT src AS id, an AS name, ak AS kind, 3 * n AS pos FROM b UNION ALL SELECT dst, zn, zk, 3 * n + 1 FROM b),
l AS (SELECT 0 AS pos, 'graph TD' AS line UNION ALL SELECT min(pos), '  n_' || regexp_replace(id, '[^a-zA-Z0-9_]', '_', 'g') || '["' || replace(regexp_replace(name, '(["\\])', '\\\1', 'g'), chr(10), ' ') || ' (' || kind || ')"]' FROM x GROUP BY id, name, kind
UNION ALL SELECT 3 * n + 2, '  n_' || regexp_replace(src, '[^a-zA-Z0-9_]', '_', 'g') || ' ' || CASE kind WHEN 'calls' THEN '-->' WHEN 'imports' THEN '-.->' ELSE '==>' END || '|"' || kind || '"| n_' || regexp_replace(dst, '[^a-zA-Z0-9_]', '_', 'g') FROM b)
SELECT (row_number() OVER (ORDER BY pos) - 1)::INTEGER AS place, line FROM l""")
def mermaid_lines(spark, d):
    return R.diagram_lines(nodes(spark, d), edges(spark, d))


@query("mermaid_sanitize", FX + r""" SELECT id, 'n_' || regexp_replace(id, '[^a-zA-Z0-9_]', '_', 'g') AS safe, replace(regexp_replace('"' || name || '\' || chr(10), '(["\\])', '\\\1', 'g'), chr(10), ' ') AS text FROM fx_nodes""")
def mermaid_sanitize(spark, d):
    """Ids made safe, and names, in quotes and with a backslash and a line break, escaped."""
    text = F.concat(F.lit('"'), "name", F.lit("\\\n"))
    return nodes(spark, d).select("id", X.diagram_id(F.col("id")).alias("safe"), X.diagram_text(text).alias("text"))


@query("identity_hash", FX + " SELECT id, 'node:' || sha256(concat_ws(chr(0), kind, name, path)) AS hashed FROM fx_nodes")
def identity_hash(spark, d):
    return nodes(spark, d).select("id", X.identity("node:", F.col("kind"), F.col("name"), F.col("path")).alias("hashed"))


@query("health_score", f"""
WITH c AS (SELECT repo, count(*) AS total_files, count(*) FILTER (regexp_matches(path, '{SUPPORTED}')) AS analyzed_files, count(*) > 80 AS truncated FROM ({FILES_OF.sql}) GROUP BY repo),
d AS (SELECT repo, count(*) FILTER (code = 'TS_PARSE_ERROR') AS syntax, count(*) FILTER (code = 'MODULE_UNRESOLVED') AS unresolved, count(*) FILTER (code = 'SOURCE_FILE_UNSUPPORTED') AS unsupported FROM ({REPOSITORY_DIAGNOSTICS.sql}) GROUP BY repo),
x AS (SELECT repo, coalesce(syntax, 0) AS syntax, coalesce(unresolved, 0) AS unresolved, coalesce(unsupported, 0) AS unsupported, total_files, analyzed_files, total_files - analyzed_files AS skipped_files, truncated FROM c LEFT JOIN d USING (repo))
SELECT *, (CASE WHEN syntax = 0 THEN 40 ELSE 0 END + CASE WHEN unresolved / total_files < 0.05 THEN 30 ELSE 0 END + CASE WHEN skipped_files = 0 THEN 20 ELSE 0 END + CASE WHEN truncated THEN 0 ELSE 10 END)::INTEGER AS score FROM x""")
def health_score(spark, d):
    """Health of every repository from its files' coverage and its diagnostics."""
    read = F.count_if(F.col("path").rlike(SUPPORTED))
    coverage = FILES_OF.read(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"), read.alias("analyzed_files"), (F.count(F.lit(1)) > 80).alias("truncated"))
    return R.graph_health(coverage, REPOSITORY_DIAGNOSTICS.read(spark, d), "repo")
