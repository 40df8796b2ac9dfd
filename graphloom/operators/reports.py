"""Reports derived from the graph: architecture, impact, change risk, diff, health, answers, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.order import order_key
from graphloom.operators.graph import levels
from graphloom.operators.ranks import RankIndex
from graphloom.schema import IMPACT_KINDS, STRUCTURE_KINDS
from graphloom.sources.shared import written


def file_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different files (from_path, to_path, kind), without structure edges."""
    at = nodes.filter(F.col("path").isNotNull()).select("id", "path")
    e = edges.filter(~F.col("kind").isin(*STRUCTURE_KINDS))
    e = e.join(at.select(F.col("id").alias("src"), F.col("path").alias("from_path")), "src")
    e = e.join(at.select(F.col("id").alias("dst"), F.col("path").alias("to_path")), "dst")
    return e.filter("from_path <> to_path").select("from_path", "to_path", "kind")


def hub_modules(nodes: DataFrame, edges: DataFrame, k: int | None = 10) -> DataFrame:
    """Files by fan-in plus fan-out, ties by path."""
    e = file_edges(nodes, edges)
    fan = e.select(F.explode(F.array(F.struct(F.col("from_path").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_path").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("f"))
    out = fan.groupBy("f.path").agg(F.sum("f.i").alias("fan_in"), F.sum("f.o").alias("fan_out")).withColumn("total", F.col("fan_in") + F.col("fan_out"))
    return out if k is None else out.orderBy(F.desc("total"), "path").limit(k)


def directory_flows(nodes: DataFrame, edges: DataFrame, k: int | None = 15) -> DataFrame:
    e = file_edges(nodes, edges).select(X.top_directory(F.col("from_path")).alias("from_dir"), X.top_directory(F.col("to_path")).alias("to_dir"))
    out = e.filter("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("edges"))
    return out if k is None else out.orderBy(F.desc("edges"), "from_dir", "to_dir").limit(k)


def directory_files(nodes: DataFrame) -> DataFrame:
    files = nodes.filter(F.col("path").isNotNull())
    return files.groupBy(X.top_directory(F.col("path")).alias("dir")).agg(F.countDistinct("path").alias("files"))


def directory_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dir, files, fan_in, fan_out of every top directory: its files, and the edges between files of different
    directories that enter and leave it."""
    flows = directory_flows(nodes, edges, None)
    side = lambda dir_, i, o: F.struct(F.col(dir_).alias("dir"), (F.col("edges") * i).alias("i"), (F.col("edges") * o).alias("o"))
    fan = flows.select(F.explode(F.array(side("to_dir", 1, 0), side("from_dir", 0, 1))).alias("f")).groupBy("f.dir").agg(F.sum("f.i").alias("fan_in"), F.sum("f.o").alias("fan_out"))
    none = F.lit(0).cast("long")
    return directory_files(nodes).join(fan, "dir", "left").select("dir", "files", F.coalesce("fan_in", none).alias("fan_in"), F.coalesce("fan_out", none).alias("fan_out"))


def file_relationships(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Edges that leave or enter a file, with the node at the far end; outgoing where both hold."""
    own = nodes.filter(F.col("path") == path).select("id")
    far = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("path").alias("other_path"))
    e = edges.filter(~F.col("kind").isin(*STRUCTURE_KINDS))
    out = e.join(own.withColumnRenamed("id", "src"), "src").join(own.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.lit("outgoing").alias("direction"), "kind", F.col("dst").alias("other"))
    into = e.join(own.withColumnRenamed("id", "dst"), "dst").join(own.withColumnRenamed("id", "src"), "src", "left_anti").select(F.lit("incoming").alias("direction"), "kind", F.col("src").alias("other"))
    return out.unionByName(into).join(far, "other").select("direction", "kind", "other", "other_name", "other_path").distinct()


def file_details(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "binary") -> DataFrame:
    """What a file's page shows, in order: place, what (symbol, route or relationship), id, kind, direction, name, path,
    line.  edges: id, src, dst, kind, line (of the first evidence).

    A relationship is an edge between the file's nodes and others, outgoing where both ends are the file's; repeated
    edges stay, each with its id.  Symbols and routes come in id order, relationships by direction, kind, path, name and
    id."""
    own = nodes.filter(F.col("path") == path)
    ids = F.broadcast(own.select("id", F.lit(True).alias("own"))) if own.limit(OWN_NODES + 1).count() <= OWN_NODES else own.select("id", F.lit(True).alias("own"))
    e = edges.filter(~F.col("kind").isin(*STRUCTURE_KINDS))
    e = e.join(ids.select(F.col("id").alias("src"), F.col("own").alias("leaves")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.col("own").alias("enters")), "dst", "left")
    e = e.filter(F.coalesce("leaves", F.lit(False)) != F.coalesce("enters", F.lit(False)))
    out = F.col("leaves").isNotNull()
    e = e.select(F.lit("relationship").alias("what"), "id", "kind", F.when(out, "outgoing").otherwise("incoming").alias("direction"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), "line")
    far = nodes.select(F.col("id").alias("other"), "name", "path")
    related = e.join(far, "other").select("what", "id", "kind", "direction", "name", "path", "line")
    none = F.lit(None)
    shown = own.filter(F.col("kind").isin("symbol", "route")).select(F.col("kind").alias("what"), "id", "kind", none.cast("string").alias("direction"), "name", "path", none.cast("int").alias("line"))
    rows = shown.unionByName(related)
    first = F.when(F.col("what") == "symbol", 0).when(F.col("what") == "route", 1).otherwise(2)
    keys = order_key("direction", "kind", "path", "name", "id", mode=mode)
    key = [F.when(first == 2, k) for k in keys]
    order = [first, *key, *order_key("id", mode=mode)]
    return RankIndex(rows, order).page().withColumn("place", F.col("pos") + 1).drop("pos")


#: Nodes of one file that are sent to every task; a file with more is joined.
OWN_NODES = 10_000


def impacted_files(nodes: DataFrame, edges: DataFrame, path: str, max_depth: int = 3, max_results: int | None = 50) -> DataFrame:
    """Files that reach a file over impact edges: path, depth and the kinds of the edges into the level before;
    the first max_results by depth and path."""
    at = nodes.filter(F.col("path").isNotNull()).select("id", "path")
    e = edges.filter(F.col("kind").isin(*IMPACT_KINDS))
    e = e.join(at.select(F.col("id").alias("src"), F.col("path").alias("f")), "src").join(at.select(F.col("id").alias("dst"), F.col("path").alias("t")), "dst")
    between = written(e.filter("f <> t").select(F.col("f").alias("src"), F.col("t").alias("dst"), "kind").distinct())
    start = nodes.sparkSession.createDataFrame([(path,)], "id string")
    seen = levels(between, start, "incoming", None, max_depth).select(F.col("id").alias("path"), "depth")
    near = seen.select(F.col("path").alias("dst"), (F.col("depth") + 1).alias("depth"))
    kinds = between.join(near, "dst").select(F.col("src").alias("path"), "depth", "kind")
    kinds = seen.filter("depth > 0").join(kinds, ["path", "depth"]).groupBy("path", "depth").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return kinds if max_results is None else kinds.orderBy("depth", "path").limit(max_results)


def change_impact(nodes: DataFrame, edges: DataFrame, changes: DataFrame, max_depth: int = 4) -> DataFrame:
    """Nodes reached from nodes in changed files against the edges: id, depth (0: in a changed file)."""
    direct = nodes.join(changes.select("path").distinct(), "path", "left_semi").select("id")
    return levels(edges.filter(~F.col("kind").isin(*STRUCTURE_KINDS)), direct, "incoming", None, max_depth).select("id", "depth")


def transitive_impacts(nodes: DataFrame, edges: DataFrame, changes: DataFrame, max_depth: int = 4) -> DataFrame:
    """node_id, kind, name, path, distance, via_edge_kind of the nodes that change_impact reaches beyond the changed
    files; via_edge_kind is that of the edge by which a queue meets the node first.

    A queue takes nodes in the order in which they came, and each one's edges in theirs.  That order is the order of
    trails, the lists of steps that led to a node, so a node's first edge is the smallest trail's: one aggregate a
    level, without numbering a level's nodes."""
    start = nodes.join(changes.select("path").distinct(), "path", "left_semi").select("id")
    hops = edges.filter(~F.col("kind").isin(*STRUCTURE_KINDS)).groupBy(F.col("dst").alias("at"), F.col("src").alias("to")).agg(F.min("kind").alias("kind"))
    hops = written(hops)
    none = F.lit(None).cast("string")
    last = written(start.distinct().select("id", F.array("id").alias("trail"), none.alias("via"), F.lit(0).alias("distance")))
    seen = last
    for distance in range(1, max_depth + 1):
        found = hops.join(last.select(F.col("id").alias("at"), "trail"), "at").join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        first = found.groupBy("to").agg(F.min(F.struct(F.concat("trail", F.array("to")).alias("trail"), "kind")).alias("b"))
        last = written(first.select(F.col("to").alias("id"), "b.trail", F.col("b.kind").alias("via"), F.lit(distance).alias("distance")))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    met = seen.filter("distance > 0").select("id", "distance", F.col("via").alias("via_edge_kind"))
    return nodes.join(met, "id").select(F.col("id").alias("node_id"), "kind", "name", "path", "distance", "via_edge_kind")


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "critical").when(score >= 45, "high").when(score >= 20, "medium").otherwise("low")


def change_risk(nodes: DataFrame, changes: DataFrame, reached: DataFrame) -> DataFrame:
    """One row: risk score and level of a change set, from capped sums."""
    hit = nodes.join(reached, "id")
    per = hit.agg(
        F.count_if((F.col("depth") == 0) & (F.col("kind") == "symbol") & F.coalesce("exported", F.lit(False))).alias("exports"),
        F.count_if(F.col("kind") == "route").alias("routes"),
        F.count_if(F.col("depth") > 0).alias("transitive"),
    )
    files = changes.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "deleted").alias("deletions"))
    size = F.when(F.col("files") > 15, 25).when(F.col("files") > 5, 15).otherwise(0)
    spread = F.when(F.col("transitive") > 20, 20).when(F.col("transitive") > 5, 10).otherwise(0)
    parts = [size, F.least(10 * F.col("deletions"), F.lit(30)), F.least(10 * F.col("exports"), F.lit(30)), F.least(15 * F.col("routes"), F.lit(30)), spread]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    one = per.crossJoin(files)  # one row each
    return one.withColumn("score", F.least(score, F.lit(100)).cast("long")).withColumn("level", risk_level(F.col("score")))


def risk_factors(nodes: DataFrame, changes: DataFrame, reached: DataFrame, order: str = "place") -> DataFrame:
    """place, title, score, reason of what makes up a change set's risk; scores are capped each, not as a whole.
    Deleted files are named up to three, in order."""
    risk = change_risk(nodes, changes, reached)
    first = changes.filter("status = 'deleted'").orderBy(order, "path").limit(3).agg(F.array_sort(F.collect_list(F.struct(order, "path"))).alias("gone"))
    row = risk.crossJoin(first)  # one row each
    said = lambda text, n: F.format_string(text, n)
    gone = F.array_join(F.col("gone")["path"], ", ")
    # Titles and reasons.
    factors = [
        (F.when(F.col("files") > 15, "Large PR Scope").when(F.col("files") > 5, "Moderate PR Scope"), F.when(F.col("files") > 15, 25).otherwise(15), said("%d files modified in PR", "files")),
        (F.when(F.col("deletions") > 0, "File Deletions"), F.least(10 * F.col("deletions"), F.lit(30)), F.concat(said("%d file(s) deleted: ", "deletions"), gone)),
        (F.when(F.col("exports") > 0, "Exported Interface Changes"), F.least(10 * F.col("exports"), F.lit(30)), said("%d exported symbol(s) modified", "exports")),
        (F.when(F.col("routes") > 0, "API Endpoint Impact"), F.least(15 * F.col("routes"), F.lit(30)), said("%d HTTP route(s) in blast radius", "routes")),
        (F.when(F.col("transitive") > 20, "High Transitive Blast Radius").when(F.col("transitive") > 5, "Moderate Blast Radius"), F.when(F.col("transitive") > 20, 20).otherwise(10), said("%d dependent graph nodes impacted", "transitive")),
    ]
    rows = [F.struct(F.lit(i).alias("place"), title.alias("title"), score.cast("long").alias("score"), reason.alias("reason")) for i, (title, score, reason) in enumerate(factors, 1)]
    return row.select(F.inline(F.array(*rows))).filter("title IS NOT NULL")


def diff_nodes(base: DataFrame, target: DataFrame) -> DataFrame:
    """Nodes of one graph alone, by kind, path and name: change, kind, path, name."""
    key = lambda g: g.select("kind", F.coalesce("path", F.lit("")).alias("path"), "name").distinct()
    b, t = key(base).withColumn("in_base", F.lit(1)), key(target).withColumn("in_target", F.lit(1))
    both = b.join(t, ["kind", "path", "name"], "full_outer").filter("in_base IS NULL OR in_target IS NULL")
    return both.select(F.when(F.col("in_base").isNull(), "added").otherwise("removed").alias("change"), "kind", "path", "name")


def diff_edges(base: DataFrame, target: DataFrame) -> DataFrame:
    key = ["src", "dst", "kind"]
    added = target.join(base, key, "left_anti").select(F.lit("added").alias("change"), *key)
    return added.unionByName(base.join(target, key, "left_anti").select(F.lit("removed").alias("change"), *key))


def diff_summary(base_nodes: DataFrame, target_nodes: DataFrame, base_edges: DataFrame, target_edges: DataFrame) -> DataFrame:
    """One row of nine counters: files, symbols, routes and edges added and removed, and files in both.

    Nodes meet by kind, path and name, each key once; edges by ends and kind, every row counting."""
    key = lambda g, mark: g.select("kind", F.coalesce("path", F.lit("")).alias("path"), "name").distinct().withColumn(mark, F.lit(True))
    both = key(base_nodes, "b").join(key(target_nodes, "t"), ["kind", "path", "name"], "full_outer")
    added, removed, kept = F.col("b").isNull(), F.col("t").isNull(), F.col("b").isNotNull() & F.col("t").isNotNull()
    per = [F.count_if((F.col("kind") == k) & hit).alias(f"{name}_{k}s") for k in ("file", "symbol", "route") for name, hit in (("added", added), ("removed", removed))]
    n = both.agg(*per, F.count_if((F.col("kind") == "file") & kept).alias("modified_files"))
    e = diff_edges(base_edges, target_edges).agg(F.count_if(F.col("change") == "added").alias("added_edges"), F.count_if(F.col("change") == "removed").alias("removed_edges"))
    return n.crossJoin(e)  # one row each


def breaking_warnings(base: DataFrame, target: DataFrame) -> DataFrame:
    """Warnings of exported symbols and routes that the target lacks, one for each key."""
    key = ["kind", "place", "name"]
    at = lambda g: g.withColumn("place", F.coalesce("path", F.lit("")))
    gone = at(base).filter(F.col("kind").isin("symbol", "route")).join(at(target).select(*key), key, "left_anti")
    gone = gone.groupBy(*key).agg(F.max_by("exported", "id").alias("exported"))  # of nodes with one key the last counts
    symbol = F.format_string("Exported symbol `%s` in `%s` was removed.", "name", F.when(F.col("place") == "", "unknown").otherwise(F.col("place")))
    text = F.when(F.col("kind") == "route", F.format_string("Route endpoint `%s` was removed.", "name")).when(F.col("exported"), symbol)
    return gone.select("kind", "name", text.alias("warning")).filter("warning IS NOT NULL")


def affected(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """what, id, name, path of a change set's affected routes, tests, schemas and public exports, from
    reached(id, depth).  A symbol whose name says test is a test wherever it lies."""
    n = nodes.join(reached.select("id", "depth"), "id", "left")
    seen, path = F.col("depth").isNotNull(), F.coalesce("path", F.lit(""))
    marks = F.array_compact(
        F.array(
            F.when(seen & (F.col("kind") == "route"), "route"),
            F.when(((F.col("kind") == "symbol") & F.lower("name").contains("test")) | (path.contains("test") & seen), "test"),
            F.when(seen & (F.col("kind") == "schema"), "schema"),
            F.when((F.col("depth") == 0) & (F.col("kind") == "symbol") & F.coalesce("exported", F.lit(False)), "export"),
        )
    )
    return n.select(F.explode(marks).alias("what"), "id", "name", "path")


def change_summary(nodes: DataFrame, changes: DataFrame, reached: DataFrame) -> DataFrame:
    """One row: the sentence that sums a change set up."""
    direct = reached.agg(F.count_if(F.col("depth") == 0).alias("direct"))
    risk = change_risk(nodes, changes, reached).crossJoin(direct)  # one row each
    text = "PR touches %d file(s) impacting %d direct node(s) and %d transitive node(s). %d route(s) and %d public export(s) affected. Risk score: %d/100 (%s)."
    return risk.select(F.format_string(text, "files", "direct", "transitive", "routes", "exports", "score", F.upper("level")).alias("summary"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Equal edges (src, dst, kind, provenance, confidence) become one: the smallest id, the sorted union of
    evidence.  Evidence is made distinct before it is gathered, so a hot edge's repeats don't add up."""
    key = ["src", "dst", "kind", "provenance", "confidence"]
    ids = edges.groupBy(*key).agg(F.min("id").alias("id"))
    rows = edges.select(*key, F.explode_outer("evidence").alias("evidence"))
    seen = rows.groupBy(*key).agg(F.sort_array(F.collect_set("evidence")).alias("evidence"))
    same = [ids[c].eqNullSafe(seen[c]) for c in key]
    return ids.join(seen, same).select(*[ids[c] for c in key], "id", "evidence")


#: Codes of diagnostics by class; a code may be in several.
SYNTAX = r"(?i)SYNTAX|PARSE|PARSE_ERROR|UNSUPPORTED_SYNTAX"
UNRESOLVED = r"(?i)IMPORT|UNRESOLVED|MISSING_MODULE|MODULE_NOT_FOUND"
UNSUPPORTED = r"(?i)UNSUPPORTED|UNSUPPORTED_FILE|FILE_TYPE"


def diagnostic_counts(diagnostics: DataFrame, *by: str) -> DataFrame:
    """Diagnostics of each class, by the given columns."""
    code = F.col("code")
    return diagnostics.groupBy(*by).agg(F.count_if(code.rlike(SYNTAX)).alias("syntax"), F.count_if(code.rlike(UNRESOLVED)).alias("unresolved"), F.count_if(code.rlike(UNSUPPORTED)).alias("unsupported"))


def health(total_files: Column, syntax: Column, unresolved: Column, skipped: Column, truncated: Column) -> Column:
    """0 to 100: 40 without syntax errors, 30 below 5 % unresolved, 20 with nothing skipped, 10 untruncated."""
    ratio = F.when(total_files > 0, unresolved / total_files).otherwise(0.0)
    return F.when(syntax == 0, 40).otherwise(0) + F.when(ratio < 0.05, 30).otherwise(0) + F.when(skipped == 0, 20).otherwise(0) + F.when(~truncated, 10).otherwise(0)


def graph_health(coverage: DataFrame, diagnostics: DataFrame, key: str) -> DataFrame:
    """Of each graph in coverage(key, total_files, analyzed_files, truncated): its diagnostics by class, the files that
    were skipped, and its health score.  diagnostics(key, code) of graphs without coverage are left aside; a graph without
    diagnostics has none of any class."""
    counts = diagnostic_counts(diagnostics, key)
    none = F.lit(0).cast("long")
    out = coverage.join(counts, key, "left")
    n = {c: F.coalesce(c, none) for c in ("syntax", "unresolved", "unsupported")}
    skipped = F.col("total_files") - F.col("analyzed_files")
    score = health(F.col("total_files"), n["syntax"], n["unresolved"], skipped, F.col("truncated"))
    return out.select(key, *[c.alias(name) for name, c in n.items()], "total_files", "analyzed_files", skipped.alias("skipped_files"), "truncated", score.cast("int").alias("score"))


#: Words of questions that don't count.
STOP_WORDS = ("and", "are", "does", "from", "how", "repository", "the", "this", "what", "where", "which", "with")
ABOUT_ROUTES = r"(?i)\b(api|endpoint|request|route)\b"
#: Questions that a local answer knows, and the words it ignores.
ABOUT_LOGIN, ABOUT_API = r"auth|login|session", r"route|api|request|endpoint"


def question_tokens(question: Column) -> Column:
    """First 12 distinct tokens of three characters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9_@./-]{3,}"), F.lit(0))
    return F.slice(F.filter(F.array_distinct(found), lambda t: ~t.isin(*STOP_WORDS)), 1, 12)


def fact(name: Column, kind: Column, path: Column, method: Column) -> Column:
    """What a node's fact says."""
    what = F.when(kind == "route", F.concat_ws(" ", method, name)).otherwise(F.concat_ws(" ", kind, name))
    return F.concat(what, F.lit(" is declared in "), path, F.lit("."))


def answer(nodes: DataFrame, question: str, k: int = 10) -> DataFrame:
    """Facts that answer a question, best first: place, citation, id, score, path, text.

    A located node scores 1 for each token it holds, and 100 if it is a route and the question is about
    them; ties by path, then name."""
    tokens = question_tokens(F.lit(question))
    hay = F.lower(F.concat_ws(" ", "name", "kind", "path", "symbol_kind", "method"))
    score = F.size(F.filter(tokens, lambda t: F.contains(hay, t)))
    routes = F.lit(question).rlike(ABOUT_ROUTES) & (F.col("kind") == "route")
    scored = nodes.filter("path IS NOT NULL").withColumn("score", (score + F.when(routes, 100).otherwise(0)).cast("long")).filter("score > 0")
    order = [F.desc("score"), "path", "name", "id"]
    best = scored.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    text = fact(F.col("name"), F.col("kind"), F.col("path"), F.col("method"))
    return best.select("place", F.concat(F.lit("citation-"), F.col("place").cast("string")).alias("citation"), "id", "score", "path", text.alias("text"))


def answer_confidence(facts: DataFrame) -> DataFrame:
    """One row: how sure an answer is, and what it doesn't know."""
    n = F.count(F.lit(1))
    sure = F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("insufficient")
    return facts.agg(n.alias("facts"), sure.alias("confidence"), F.when(n == 0, "Indexed graph contains insufficient evidence to answer this question.").alias("unknown"))


def local_answer(question: str, symbols: DataFrame, routes: DataFrame) -> DataFrame:
    """place, title, evidence: what a model's symbols(name, path, line) and routes(method, route, path, line) say to
    a question, from the first match in file and line order; one row without evidence if nothing does."""
    asked = question.lower()
    at = lambda *parts: F.concat_ws(":", *parts)
    if re.search(ABOUT_LOGIN, asked):
        hit = symbols.filter(F.concat("name", "path").rlike(f"(?i){ABOUT_LOGIN}"))
        rows, k, evidence = hit, 8, at("path", F.col("line").cast("string"))
        titles = F.lit("Authentication-related code found"), F.lit("No authentication implementation verified")
    elif re.search(ABOUT_API, asked):
        rows, k, evidence = routes, 10, F.concat(F.concat_ws(" ", "method", "route"), F.lit(" — "), "path")
        titles = F.lit(None), F.lit("0 route definitions detected")
    else:
        tokens = [t for t in re.split(r"\W+", asked, flags=re.ASCII) if len(t) > 2]
        hay = F.lower(F.concat("name", "path"))
        hit = F.lit(False)
        for t in tokens:
            hit = hit | hay.contains(t)
        rows, k, evidence = symbols.filter(hit), 10, F.concat("name", F.lit(" — "), at("path", F.col("line").cast("string")))
        titles = F.lit(None), F.lit("No supported answer found")
    order = ["path", "line", evidence]
    first = rows.orderBy(*order).limit(k).select(F.row_number().over(Window.orderBy(*order)).alias("place"), evidence.alias("evidence"))
    # routes are counted as a whole, definitions as shown
    n = rows.agg(F.count(F.lit(1)).alias("n")) if re.search(ABOUT_API, asked) and not re.search(ABOUT_LOGIN, asked) else first.agg(F.count(F.lit(1)).alias("n"))
    shown = n.join(first, F.lit(True), "left")  # one row, and at most ten
    counted = F.concat(F.col("n").cast("string"), F.lit(" route definitions detected" if re.search(ABOUT_API, asked) else " relevant definitions found"))
    title = F.when(F.col("n") == 0, titles[1]).otherwise(F.coalesce(titles[0].cast("string"), counted))
    return shown.select(F.coalesce("place", F.lit(0)).alias("place"), title.alias("title"), "evidence")


#: Longest lists of the compatibility model.
LEGACY_EDGES, LEGACY_SYMBOLS, LEGACY_ROUTES = 800, 1_500, 300


def legacy_lists(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Lists of the compatibility model by name, one item a row: imports between a file and what it names,
    symbols by file, line, name and kind, routes by method, packages that edges lead to, and files."""
    files = nodes.filter((F.col("kind") == "file") & F.col("path").isNotNull())
    line = F.col("line") if "line" in nodes.columns else F.lit(None)
    e = edges.filter(F.col("kind").isin("imports", "requires")).join(files.select(F.col("id").alias("src"), "path"), "src")
    kind = F.when(F.col("kind") == "requires", "require").otherwise("import").alias("kind")
    e = e.select("path", "dst", kind).distinct().orderBy("path", "dst", "kind").limit(LEGACY_EDGES)
    symbols = nodes.filter((F.col("kind") == "symbol") & F.col("path").isNotNull()).withColumn("at", F.lpad(F.coalesce(line, F.lit(1)).cast("string"), 10, "0"))
    symbols = symbols.orderBy("path", "at", "name", "symbol_kind").limit(LEGACY_SYMBOLS)
    routes = nodes.filter((F.col("kind") == "route") & F.col("path").isNotNull()).withColumn("one", F.explode(F.split("method", ",")))
    routes = routes.orderBy("path", "name", "one").limit(LEGACY_ROUTES)
    packages = nodes.filter("kind = 'package'").join(edges.select(F.col("dst").alias("id")), "id", "left_semi")
    item = lambda *c: F.concat_ws(":", *c).alias("item")
    return {
        "edges": e.select(item("path", "dst", "kind")),
        "symbols": symbols.select(item("path", "at", "name", "symbol_kind")),
        "routes": routes.select(item("path", "name", "one")),
        "dependencies": packages.select(F.col("name").alias("item")).distinct(),
        "sources": files.select(F.col("path").alias("item")),
    }


def diagram_lines(nodes: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    """place, line of a flow diagram: of the first k edges other than structure, sorted by their ends and kind, each
    node where it is first met and each edge with an arrow by kind.  Edges without an end are left out."""
    e = edges.filter(~F.col("kind").isin(*STRUCTURE_KINDS)).orderBy("src", "dst", "kind").limit(k)
    e = e.withColumn("n", F.row_number().over(Window.orderBy(F.concat("src", "dst", "kind"))))  # k rows
    label = F.concat(F.lit('["'), X.diagram_text(F.col("name")), F.lit(" ("), F.col("kind"), F.lit(')"]'))
    names = nodes.select("id", label.alias("label"))
    both = e.join(names.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    both = written(both)
    ends = both.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("a").alias("label"), (3 * F.col("n")).alias("at")), F.struct(F.col("dst").alias("id"), F.col("b").alias("label"), (3 * F.col("n") + 1).alias("at")))).alias("x")).select("x.*")
    boxes = ends.groupBy("id", "label").agg(F.min("at").alias("at")).select("at", F.concat(F.lit("  "), X.diagram_id(F.col("id")), "label").alias("line"))
    arrow = F.when(F.col("kind") == "calls", "-->").when(F.col("kind") == "imports", "-.->").otherwise("==>")
    flows = both.select((3 * F.col("n") + 2).alias("at"), F.concat(F.lit("  "), X.diagram_id(F.col("src")), F.lit(" "), arrow, F.lit('|"'), "kind", F.lit('"| '), X.diagram_id(F.col("dst"))).alias("line"))
    head = nodes.sparkSession.createDataFrame([(0, "graph TD")], "at int, line string")
    lines = head.unionByName(boxes).unionByName(flows)
    empty = lines.agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.lit(1).alias("at"), F.lit("  no_edges[No structural relationships found]").alias("line"))
    return lines.unionByName(empty).select((F.row_number().over(Window.orderBy("at")) - 1).alias("place"), "line")  # at most 3 k + 1 rows


def admission(entries: DataFrame, max_files: int, max_bytes: int, by=None) -> DataFrame:
    """Which entries(path, size, ok) are taken, in path order, up to a number of files.

    The running count is a window over each snapshot (`by`), whose number of entries has a bound."""
    w = Window.partitionBy(*(by or [])).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("ok") & (F.col("size") <= max_bytes)
    seen = F.sum(fits.cast("int")).over(w)
    reason = F.when(~F.col("ok"), "kind").when(F.col("size").isNull(), "unknown-size").when(F.col("size") > max_bytes, "file-size-limit").when(seen > max_files, "analyzed-file-limit")
    return entries.withColumn("reason", reason)


def greedy_budget(entries: DataFrame, by: str, budget: int) -> DataFrame:
    """Entries(by, path, size) taken in path order while they fit what is left of a byte budget; one
    that doesn't fit is passed over.

    A snapshot's choice hangs on each choice before, so its entries are streamed in order with one running
    sum; snapshots are dealt out, and none is ever gathered."""
    kind = entries.schema[by].dataType.simpleString()

    def take(batches):
        now, used = object(), 0
        for batch in batches:
            taken = []
            for key, size in zip(batch[by].astype(object).where(batch[by].notna(), None), batch["size"]):
                if key != now:
                    now, used = key, 0
                fits = used + size <= budget
                used += size if fits else 0
                taken.append(bool(fits))
            yield batch[[by, "path"]].assign(taken=taken)

    rows = entries.select(by, "path", F.col("size").cast("long").alias("size")).repartition(by).sortWithinPartitions(by, "path", "size")
    return rows.mapInPandas(take, f"{by} {kind}, path string, taken boolean")
