"""Exports of the graph as documents, and content-addressed storage decisions.

A document is a table of lines (section, place, line) whose order is that of section and place, so that
large ones are written as sorted part files and none is put together in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import canonical as K
from graphloom.operators import reports as R

#: Metrics of a report in their order, by node kind.
METRICS = (("Files", "file"), ("Symbols", "symbol"), ("Routes", "route"), ("Packages", "package"))
#: Characters that HTML escapes, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
#: Content type and file ending of each format; any other is JSON.
FORMATS = {"mermaid": ("text/plain; charset=utf-8", "graph.mmd"), "report": ("text/markdown; charset=utf-8", "GRAPH_REPORT.md"), "html": ("text/html; charset=utf-8", "graph.html"), "json": ("application/json; charset=utf-8", "graph.json")}
LINE = "section int, place string, line string"


def html_escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def html_rows(nodes: DataFrame, k: int = 100) -> DataFrame:
    """id and table row of the first k nodes by id."""
    cell = lambda c: html_escape(F.coalesce(c, F.lit("-")))
    row = F.concat(F.lit("<tr><td><code>"), cell(F.col("name")), F.lit('</code></td><td><span class="badge">'), cell(F.col("kind")), F.lit("</span></td><td>"), cell(F.col("path")), F.lit("</td></tr>"))
    return nodes.orderBy("id").limit(k).select("id", row.alias("row"))


def markdown_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, place, line: the metrics and the hub modules of a report.

    Counts and hubs are aggregated by Spark; only the ten hubs are numbered in one task."""
    kinds = nodes.agg(*[F.count_if(F.col("kind") == kind).alias(kind) for _, kind in METRICS]).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    counts = [*METRICS, ("Total Edges", "edges")]
    lines = F.array(*[F.concat(F.lit(f"- **{title}:** "), F.col(c).cast("string")) for title, c in counts])
    metrics = kinds.select(F.lit(1).alias("section"), F.posexplode(lines).alias("place", "line"))
    hubs = R.hub_modules(nodes, edges)
    line = F.format_string("- `%s` (%d connections: %d in / %d out)", "path", "total", "fan_in", "fan_out")
    place = F.row_number().over(Window.orderBy(F.desc("total"), "path")) - 1
    listed = hubs.select(F.lit(2).alias("section"), place.alias("place"), line.alias("line"))
    none = listed.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(2).alias("section"), F.lit(0).alias("place"), F.lit("- No hub modules detected.").alias("line"))
    return metrics.unionByName(listed).unionByName(none)


def _fixed(nodes: DataFrame, lines: list[tuple[int, int, str]]) -> DataFrame:
    return nodes.sparkSession.createDataFrame([(a, f"{b:08d}", c) for a, b, c in lines], LINE)


def _numbered(rows: DataFrame, section: Column) -> DataFrame:
    return rows.select(section.cast("int").alias("section"), F.lpad(F.col("place").cast("string"), 8, "0").alias("place"), "line")


def mermaid_document(nodes: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    return _numbered(R.diagram_lines(nodes, edges, k), F.lit(1))


def report_document(nodes: DataFrame, edges: DataFrame, repository: str, commit: str, score: int, analyzed: int, skipped: int) -> DataFrame:
    """A report in Markdown without blank lines: what was analysed, metrics, hubs and a diagram of 30 edges."""
    head = ["# Code Graph Analysis Report", f"**Repository:** `{repository}`", f"**Commit:** `{commit}`", "**Schema:** `v2.0`", f"**Health Score:** `{score}/100` ({analyzed} analyzed, {skipped} skipped)"]
    fixed = [(0, i, t) for i, t in enumerate(head)] + [(1, 0, "## Summary Metrics"), (3, 0, "## Hub Modules"), (5, 0, "## Dependency Architecture"), (5, 1, "```mermaid"), (7, 0, "```"), (7, 1, "---"), (7, 2, "*Generated by graphloom*")]
    body = markdown_report(nodes, edges)
    out = _fixed(nodes, fixed).unionByName(_numbered(body, F.col("section") * 2)).unionByName(_numbered(R.diagram_lines(nodes, edges, 30), F.lit(6)))
    return out.filter("line <> ''")


def html_document(nodes: DataFrame, edges: DataFrame, repository: str, commit: str) -> DataFrame:
    """A page with the first 100 nodes as a table and the whole graph as JSON in it; all text is escaped."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    summary = F.format_string("<p><strong>Files:</strong> %d | <strong>Symbols:</strong> %d | <strong>Edges:</strong> %d</p><h2>Nodes (%d)</h2>", "files", "symbols", "edges", "nodes")
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    fixed = [(0, 0, f'<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>{safe(repository)}</title></head><body>'), (0, 1, f"<h1>{safe(repository)}</h1><p><strong>Commit:</strong> <code>{safe(commit)}</code></p>")]
    fixed += [(2, 0, "<table><thead><tr><th>Name</th><th>Kind</th><th>Location</th></tr></thead><tbody>"), (4, 0, '</tbody></table><script type="application/json" id="graph-data">'), (9, 0, "</script></body></html>")]
    rows = html_rows(nodes).select(F.lit(3).alias("section"), F.col("id").alias("place"), F.col("row").alias("line"))
    json = json_document(nodes, edges).select((F.col("section") + 5).alias("section"), "place", F.replace("line", F.lit("<"), F.lit("\\u003c")).alias("line"))
    return _fixed(nodes, fixed).unionByName(counts.select(F.lit(1).alias("section"), F.lit("0").alias("place"), summary.alias("line"))).unionByName(rows).unionByName(json)


def json_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The canonical graph as JSON, a node or an edge on a line, in order of their JSON, each once."""

    def listed(rows: DataFrame, section: int) -> DataFrame:
        last = rows.agg(F.max("json").alias("last"))
        end = F.when(F.col("json") == F.col("last"), "").otherwise(",")
        return rows.crossJoin(last).select(F.lit(section).alias("section"), F.col("json").alias("place"), F.concat("json", end).alias("line"))  # one row

    e = K.stable_json(**{"from": F.col("src"), "to": F.col("dst"), "kind": F.col("kind")})
    marks = [(0, 0, '{"nodes":['), (2, 0, '],"edges":['), (4, 0, "]}")]
    return _fixed(nodes, marks).unionByName(listed(K.canonical_nodes(nodes).select("json").distinct(), 1)).unionByName(listed(edges.select(e.alias("json")).distinct(), 3))


def export(nodes: DataFrame, edges: DataFrame, format: str, analysis: str, **about) -> tuple[DataFrame, str, str]:
    """Document, content type and file name of a format; what isn't known is JSON."""
    kind = format if format in FORMATS else "json"
    content, ending = FORMATS[kind]
    make = {"mermaid": lambda: mermaid_document(nodes, edges), "report": lambda: report_document(nodes, edges, **about), "html": lambda: html_document(nodes, edges, about["repository"], about["commit"]), "json": lambda: json_document(nodes, edges)}
    return make[kind](), content, f"analysis-{analysis}-{ending}"


def save(document: DataFrame, folder: str) -> None:
    """Write a document as text, part files in the order of its lines."""
    document.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("line").write.text(folder)


def put_outcomes(writes: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """writes with outcome: `stored` for the first write of a key, `same` for later ones of equal
    content, `conflict` for others.

    The first write of each key is a partial aggregate, joined back, so a key with a third of
    all writes needs no task of its own.  A null key is a key; null content equals itself."""
    hashed = writes.withColumn("__hash", F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256))
    first = hashed.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(F.col(order).alias("at"), F.col("__hash").alias("hash"))).alias("__first"))
    both = hashed.join(first, F.col(key).eqNullSafe(F.col("__key")))
    outcome = F.when(F.col(order) == F.col("__first.at"), "stored").when(F.col("__hash") == F.col("__first.hash"), "same").otherwise("conflict")
    return both.withColumn("outcome", outcome).select(*writes.columns, "outcome")
