"""Queries of exports, artifact writes and node rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import export as E
from graphloom.plans.graph_queries import FILES
from graphloom.plans.registry import query
from graphloom.sources.fixture import SQL as FX
from graphloom.sources.fixture import edges, nodes, table


@query("html_rows", FX + """, n AS (SELECT * FROM fx_nodes ORDER BY id LIMIT 100),
s AS (SELECT id, unnest([name, kind, coalesce(path, '-')]) AS cell, unnest([1, 2, 3]) AS place FROM n),
x AS (SELECT id, place, replace(replace(replace(replace(cell, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS cell FROM s)
SELECT id, '<tr><td><code>' || max(cell) FILTER (place = 1) || '</code></td><td><span class="badge">' || max(cell) FILTER (place = 2) || '</span></td><td>' || max(cell) FILTER (place = 3) || '</td></tr>' AS row FROM x GROUP BY id""")
def html_rows(spark, d):
    return E.html_rows(nodes(spark, d))


@query("markdown_report", FILES + """, f AS (SELECT from_path AS path, 0 AS i, 1 AS o FROM fe UNION ALL SELECT to_path, 1, 0 FROM fe),
h AS (SELECT path, sum(i) AS i, sum(o) AS o, sum(i) + sum(o) AS t FROM f GROUP BY path ORDER BY t DESC, path LIMIT 10),
m AS (SELECT 0 AS place, '- **Files:** ' || count(*) FILTER (kind = 'file') AS line FROM fx_nodes UNION ALL SELECT 1, '- **Symbols:** ' || count(*) FILTER (kind = 'symbol') FROM fx_nodes
UNION ALL SELECT 2, '- **Routes:** ' || count(*) FILTER (kind = 'route') FROM fx_nodes UNION ALL SELECT 3, '- **Packages:** ' || count(*) FILTER (kind = 'package') FROM fx_nodes
UNION ALL SELECT 4, '- **Total Edges:** ' || count(*) FROM fx_edges)
SELECT 1 AS section, place, line FROM m UNION ALL
SELECT 2, (row_number() OVER (ORDER BY t DESC, path) - 1)::INTEGER, '- `' || path || '` (' || t || ' connections: ' || i || ' in / ' || o || ' out)' FROM h""")
def markdown_report(spark, d):
    return E.markdown_report(nodes(spark, d), edges(spark, d))


@query("artifact_put", """WITH w AS (SELECT doc_id, concat_ws('/', source, n_chars // 50) AS key, sha256(coalesce(text, '')) AS h FROM documents),
f AS (SELECT key, min(doc_id) AS first_id, arg_min(h, doc_id) AS fh FROM w GROUP BY key)
SELECT doc_id, w.key, CASE WHEN doc_id = first_id THEN 'stored' WHEN h = fh THEN 'same' ELSE 'conflict' END AS outcome FROM w JOIN f USING (key)""")
def artifact_put(spark, d):
    key = F.concat_ws("/", "source", F.floor(F.col("n_chars") / 50).cast("string"))
    writes = table(spark, d, "documents").select("doc_id", key.alias("key"), "text")
    return E.put_outcomes(writes, "key", "doc_id", "text").select("doc_id", "key", "outcome")
