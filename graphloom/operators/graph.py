"""Bounded graph queries: search, lookup, neighbours, explain, impact and shortest path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.order import order_key
from graphloom.functions.text import NUL
from graphloom.schema import MAX_COST, MAX_RESULTS
from graphloom.sources.shared import shared_folder, written


def search(nodes: DataFrame, text: str, kinds=None, cursor: int = 0, max_results: int | None = None, mode: str = "binary") -> DataFrame:
    """Nodes whose id, name, kind, path or details hold the text, whatever its case, in id order (by code point or as
    a locale has it), from the match after `cursor`.  Ranking touches only the matches."""
    hay = F.lower(F.concat_ws(NUL, "id", "name", "kind", "path", "symbol_kind", "method"))
    found = nodes.filter(F.col("kind").isin(list(kinds)) if kinds else F.lit(True)).filter(hay.contains(text.lower()))
    return page(found, order_key("id", mode=mode), cursor, max_results)


def page(rows: DataFrame, order: list[Column], cursor: int, size: int | None) -> DataFrame:
    """Rows after the first `cursor` in an order, at most `size`: an offset cursor."""
    out = rows.orderBy(*order)
    out = out.offset(cursor) if cursor else out
    return out if size is None else out.limit(size)


def permits(node_id: Column, direction: str) -> Column:
    out, into = F.col("src") == node_id, F.col("dst") == node_id
    return {"outgoing": out, "incoming": into, "both": out | into}[direction]


def neighbors(edges: DataFrame, node_id: str, direction: str = "both", kinds=None, cursor: int = 0, max_results: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Edges at a node, paged; other is the far end.  order: as edge_order() gives it, else ends and kind."""
    at = edges.filter(permits(F.lit(node_id), direction))
    at = at.filter(F.col("kind").isin(list(kinds))) if kinds else at
    other = F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src"))
    return page(at.withColumn("other", other), order or [F.col("src"), F.col("dst"), F.col("kind")], cursor, max_results)


def steps(edges: DataFrame, direction: str, kinds=None) -> DataFrame:
    """Edges as steps (at, to, kind) in the directions that a traversal may take."""
    e = edges.filter(F.col("kind").isin(list(kinds))) if kinds else edges
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind")
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind")
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def levels(edges: DataFrame, starts: DataFrame, direction: str = "both", kinds=None, max_depth: int = 8, target: str | None = None) -> DataFrame:
    """Breadth-first levels from starts(id): id, depth, via, kind; via is the smallest node of the
    level before that leads there.

    The steps are written once, dealt by the node they leave, so a level reads two columns instead of the
    source tables.  Each level is one join and one anti-join and is appended to one folder, so nothing is
    rewritten and a lost executor repeats one level at most."""
    spark = edges.sparkSession
    hops = written(steps(edges, direction, kinds).repartition("at"))
    none = F.lit(None).cast("string")
    folder = shared_folder(spark)
    columns = ["id", "depth", "via", "kind"]
    front = starts.select("id").distinct().withColumns({"depth": F.lit(0), "via": none, "kind": none}).select(columns)
    seen = written(front, folder)
    for depth in range(1, max_depth + 1):
        last = seen.filter(F.col("depth") == depth - 1).select(F.col("id").alias("at"))
        found = last.join(hops, "at").groupBy("to").agg(F.min(F.struct("at", "kind")).alias("b")).join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        found = found.select(F.col("to").alias("id"), F.lit(depth).alias("depth"), F.col("b.at").alias("via"), F.col("b.kind").alias("kind"))
        found.write.mode("append").parquet(folder)
        seen = spark.read.schema(front.schema).parquet(folder)
        new = seen.filter(F.col("depth") == depth)
        if new.isEmpty() or (target is not None and not new.filter(F.col("id") == target).isEmpty()):
            break
    return seen


def impact(edges: DataFrame, node_id: str, direction: str = "incoming", kinds=None, max_depth: int = 8) -> DataFrame:
    start = edges.sparkSession.createDataFrame([(node_id,)], "id string")
    return levels(edges, start, direction, kinds, max_depth).select("id", "depth")


def shortest_path(edges: DataFrame, source: str, target: str, direction: str = "both", kinds=None, max_depth: int = 8) -> DataFrame:
    """step, id along one shortest path; no rows if the target isn't reached.  Backtracking takes
    one small join a step."""
    spark = edges.sparkSession
    seen = levels(edges, spark.createDataFrame([(source,)], "id string"), direction, kinds, max_depth, target)
    at = seen.filter(F.col("id") == target).select(F.col("depth").alias("step"), "id", "via")
    path = at.select("step", "id")
    for _ in range(max_depth):
        at = at.select((F.col("step") - 1).alias("step"), F.col("via").alias("id")).join(seen.select("id", "via"), "id").select("step", "id", "via")
        path = path.unionByName(at.select("step", "id"))
    return path


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order with pos from 0: n is a query's budget, so one task numbers no more."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


EDGE_ORDER = ("src", "dst", "kind")


def budgeted_levels(edges: DataFrame, source: str, direction: str, kinds, max_depth: int, max_cost: int = MAX_COST[0], max_results: int | None = None, target: str | None = None, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Breadth-first levels under a budget of scans, with joins: every node in turn looks at all edges in their
    order, at a cost of 1 each, and a node counts if it is met before the cost is spent.

    The node of rank r in a level meets the edge at position p at scan base + r * edges + p, so edges at
    positions beyond the budget are never met and only max_cost of them are numbered at all.  Returns
    the nodes met (id, s, depth, via, pos: the scan, the node and the edge that led there), the numbered
    edges, and the outcome."""
    spark = edges.sparkSession
    total = edges.count()
    first = written(ranked(edges, order or [F.col(c) for c in EDGE_ORDER], max_cost))
    e = first.filter(F.col("kind").isin(list(kinds))) if kinds else first
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "pos")
    back = e.filter("src <> dst" if direction == "both" else "true").select(F.col("dst").alias("at"), F.col("src").alias("to"), "pos")
    hops = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    seen = written(spark.createDataFrame([(source, -1, 0, None, None)], "id string, s long, depth int, via string, pos long"))
    front, base, size, reason, cost = seen.select("id", F.lit(0).alias("rank")), 0, 1, None, 0
    for depth in range(1, max_depth + 1):
        found = front.withColumnRenamed("id", "at").join(hops, "at").join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        scan = (F.lit(base) + F.col("rank") * total + F.col("pos")).alias("s")
        level = found.select("to", scan, "at", "pos").filter(F.col("s") < max_cost).groupBy(F.col("to").alias("id")).agg(F.min(F.struct("s", F.col("at").alias("via"), "pos")).alias("b"))
        # at most max_cost rows, as each takes a scan of its own
        level = written(level.select("id", "b.*").withColumn("rank", F.row_number().over(Window.orderBy("s")) - 1))
        width = front.count()
        full, over = base + width * total, False
        hit = level.filter(F.col("id") == target).select("s").first() if target is not None else None
        if hit:
            full = hit["s"] + 1
        if max_results is not None:
            last = level.filter(F.col("rank") == max_results - size).select("s").first()
            if last:
                full, over = last["s"] + 1, True
        cost = min(full, max_cost)
        kept = level.filter(F.col("s") < (min(cost, full - 1) if over else cost))
        seen = written(seen.unionByName(kept.select("id", "s", F.lit(depth).alias("depth"), "via", "pos")))
        size = seen.count()
        if full > max_cost:
            reason = "cost"
            break
        if over:
            reason = "results"
            break
        front = kept.select("id", "rank")
        if hit or front.isEmpty():
            break
        base = full
    return seen, first, {"cost": cost, "truncated": reason is not None, "truncationReason": reason}


#: Columns of an answer's envelope.
ENVELOPE = "query string, nodes long, edges long, path array<string>, cost long, truncated boolean, truncation_reason string, next_cursor long"


def _envelope(spark, name: str, nodes: int, edges: int, path, meta: dict, cursor=None) -> DataFrame:
    return spark.createDataFrame([(name, nodes, edges, path, meta["cost"], meta["truncated"], meta["truncationReason"], cursor)], ENVELOPE)


def _scanned(rows: DataFrame, order: list[Column], hit: Column, cursor: int, max_cost: int, max_results: int) -> tuple[DataFrame, dict, int | None]:
    """Rows that a scan in order selects within its budgets, after the first `cursor` matches; its cost and, if
    results ran over, the next cursor."""
    total = rows.count()
    match = written(ranked(rows, order, max_cost).filter(hit).withColumn("__m", F.row_number().over(Window.orderBy("pos"))))
    over = match.filter(F.col("__m") == cursor + max_results + 1).select("pos").first()
    chosen = match.filter((F.col("__m") > cursor) & (F.col("__m") <= cursor + max_results)).drop("__m", "pos")
    reason = "results" if over else "cost" if total > max_cost else None
    cost = over["pos"] + 1 if over else min(total, max_cost)
    return chosen, {"cost": cost, "truncated": reason is not None, "truncationReason": reason}, cursor + max_results if over else None


def node_order() -> list[Column]:
    """Canonical order of nodes: that of their stable JSON, in which a quote follows the id."""
    return [F.concat("id", F.lit('"'))]


def answer_search(nodes: DataFrame, text: str, kinds=None, cursor: int = 0, max_cost: int = MAX_COST[0], max_results: int = MAX_RESULTS[0]) -> tuple[DataFrame, DataFrame]:
    """Nodes of a search and its envelope."""
    hay = F.lower(F.concat_ws(NUL, "id", "name", "kind", "path", "symbol_kind", "method"))
    hit = hay.contains(text.lower()) & (F.col("kind").isin(list(kinds)) if kinds else F.lit(True))
    found, meta, following = _scanned(nodes, node_order(), hit, cursor, max_cost, max_results)
    return found, _envelope(nodes.sparkSession, "search", found.count(), 0, None, meta, following)


def answer_node(nodes: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    found = nodes.filter(F.col("id") == node_id)
    return found, _envelope(nodes.sparkSession, "node", found.count(), 0, None, {"cost": 1, "truncated": False, "truncationReason": None})


def answer_neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", kinds=None, cursor: int = 0, max_cost: int = MAX_COST[0], max_results: int = MAX_RESULTS[0], name: str = "neighbors", order: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and envelope: a page of the edges at a node in their order, and the nodes at their ends with
    the node itself.  An unknown node has none of either."""
    hit = permits(F.lit(node_id), direction) & (F.col("kind").isin(list(kinds)) if kinds else F.lit(True))
    found, meta, following = _scanned(edges, order or [F.col(c) for c in EDGE_ORDER], hit, cursor, max_cost, max_results)
    ids = found.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(edges.sparkSession.createDataFrame([(node_id,)], "id string")).distinct()
    ends = nodes.join(F.broadcast(ids), "id", "left_semi")  # at most twice the results and one
    return ends, found, _envelope(edges.sparkSession, name, ends.count(), found.count(), None, meta, following)


def answer_explain(nodes: DataFrame, edges: DataFrame, node_id: str, max_cost: int = MAX_COST[0], max_results: int = MAX_RESULTS[0]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything at a node: its neighbours in both directions over all kinds, from the first."""
    return answer_neighbors(nodes, edges, node_id, "both", None, 0, max_cost, max_results, "explain")


def _known(nodes: DataFrame, ids: list[str]) -> bool:
    return nodes.filter(F.col("id").isin(ids)).select("id").distinct().count() == len(set(ids))


def answer_impact(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", kinds=None, max_depth: int = 8, max_cost: int = MAX_COST[0], max_results: int = MAX_RESULTS[0], order: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes met from a node with itself, the edges that led to each, and the envelope."""
    spark = nodes.sparkSession
    if not _known(nodes, [node_id]):
        return nodes.limit(0), edges.limit(0), _envelope(spark, "impact", 0, 0, None, {"cost": 1, "truncated": False, "truncationReason": None})
    seen, first, meta = budgeted_levels(edges, node_id, direction, kinds, max_depth, max_cost, max_results, order=order)
    tree = first.join(F.broadcast(seen.filter("pos IS NOT NULL").select("pos", "s")), "pos").orderBy("s").select(*EDGE_ORDER)
    met = nodes.join(F.broadcast(seen.select("id")), "id", "left_semi")
    return met, tree, _envelope(spark, "impact", met.count(), tree.count(), None, meta)


def answer_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, direction: str = "both", kinds=None, max_depth: int = 8, max_cost: int = MAX_COST[0]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges along a shortest path and the envelope with the path; without a path, none."""
    spark = nodes.sparkSession
    none = {"cost": 1, "truncated": False, "truncationReason": None}
    if not _known(nodes, [source, target]):
        return nodes.limit(0), edges.limit(0), _envelope(spark, "shortestPath", 0, 0, None, none)
    if source == target:
        return nodes.filter(F.col("id") == source), edges.limit(0), _envelope(spark, "shortestPath", 1, 0, [source], {**none, "cost": 0})
    seen, first, meta = budgeted_levels(edges, source, direction, kinds, max_depth, max_cost, None, target)
    path, places, at = [], [], target
    for _ in range(max_depth):  # one row for each step back
        step = seen.filter((F.col("id") == at) & F.col("via").isNotNull()).select("via", "pos").first()
        if step is None:
            break
        path, places, at = [at, *path], [step["pos"], *places], step["via"]
    if not path:
        return nodes.limit(0), edges.limit(0), _envelope(spark, "shortestPath", 0, 0, None, meta)
    path = [source, *path]
    return nodes.filter(F.col("id").isin(path)), first.filter(F.col("pos").isin(places)).select(*EDGE_ORDER), _envelope(spark, "shortestPath", len(path), len(places), path, meta)
