"""The canonical form of a graph: one order, one of each, whatever order its rows came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranks import first_n


def stable_json(**fields: Column) -> Column:
    """JSON with keys in order and without nulls; whole numbers have no fraction."""
    text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.regexp_replace(text, r'("confidence":-?\d+)\.0(?=[,}])', "$1")


def node_json(n: DataFrame) -> Column:
    """Stable JSON of nodes(id, kind, name, path, symbol_kind, exported, method): what a kind of node doesn't have
    is left out."""
    location = F.when(F.col("path").isNotNull(), F.struct(F.col("path").alias("path")))
    methods = F.when(F.col("method").isNotNull(), F.array_sort(F.array_distinct(F.split("method", ","))))
    metadata = F.struct(F.col("exported").alias("exported"), methods.alias("methods"), F.col("symbol_kind").alias("symbolKind"))
    return stable_json(id=F.col("id"), kind=F.col("kind"), name=F.col("name"), location=location, metadata=metadata)


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """id and json of each node, in the order of the JSON when sorted by it."""
    return nodes.select("id", node_json(nodes).alias("json"))


IDENTITY = ("src", "dst", "kind", "provenance", "confidence", "metadata")


def with_identity(edges: DataFrame) -> DataFrame:
    """edges(id, src, dst, kind, provenance, confidence, evidence, mode, specifier, type_only, resolution, candidates)
    with metadata, its candidates as a sorted set and null for edges that are no imports, and identity."""
    metadata = F.when(F.col("resolution").isNotNull(), F.struct(F.array_sort(F.array_distinct("candidates")).alias("candidates"), "mode", "resolution", "specifier", F.col("type_only").alias("typeOnly")))
    e = edges.withColumn("metadata", metadata).withColumn("confidence", F.col("confidence") + F.lit(0.0))  # -0 is 0
    parts = stable_json(**{"from": F.col("src"), "to": F.col("dst"), "kind": F.col("kind"), "provenance": F.col("provenance"), "confidence": F.col("confidence"), "metadata": F.col("metadata")})
    return e.withColumn("identity", F.sha2(parts, 256))


def merged_edges(edges: DataFrame) -> DataFrame:
    """id, src, dst, kind, json, times: canonical edges with the number of rows that each was made of.

    One shuffle by the fields that make an edge's identity, which are its contents, so neither a digest nor a copy of
    them goes along; each task gathers its evidence as a set first, so repeats of a hot edge don't add up."""
    e = with_identity(edges).select(*IDENTITY, "id", F.posexplode_outer("evidence").alias("at", "x"))
    times = F.count_if(F.coalesce("at", F.lit(0)) == 0)
    both = e.groupBy(*IDENTITY).agg(F.min("id").alias("id"), F.sort_array(F.collect_set("x")).alias("evidence"), times.alias("times"))
    json = stable_json(**{"id": F.col("id"), "from": F.col("src"), "to": F.col("dst"), **{k: F.col(k) for k in ("kind", "provenance", "confidence", "metadata", "evidence")}})
    return both.select("id", "src", "dst", "kind", json.alias("json"), "times")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """id, src, dst, kind, json: edges of one identity become one, with the smallest id and the sorted set of their
    evidence; json is the key of their order."""
    return merged_edges(edges).drop("times")


def marks(json: Column) -> tuple[Column, Column]:
    """Two numbers of a row's digest: a fingerprint adds up the first and takes the exclusive or of the second."""
    part = lambda at, n: F.conv(F.substring(F.md5(json), at, n), 16, 10).cast("long")
    return part(1, 6), part(7, 8)


def assemble(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical nodes and edges of a graph put together from files in any order, with repeats, and a report: what was
    broken before and after (rule, n) and the fingerprints.

    Validated, made canonical and validated again.  The same rows in another order, or twice, give the same graph."""
    with_json = nodes.withColumn("json", node_json(nodes))
    return with_json.dropDuplicates(["json"]), canonical_edges(edges), report(with_json, edges)


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, n, total, mixed: how often a rule of C.graph_violations was broken before and after nodes(id, kind, json)
    and edges became one of each, and the fingerprints of both: a count and two sums over digests, which no order of
    rows or partitions changes.  Two sets of different rows with one fingerprint are as good as impossible.

    Equal rows are counted where they become one, so what was broken before is read off the same rows.  Nodes and the
    ends of edges then meet in one aggregate by id, which has no joins and reads each side once."""
    one = F.lit(1).cast("long")
    node = nodes.groupBy("json", "id", "kind").agg(F.count(F.lit(1)).alias("times"))
    end = F.explode(F.array(F.struct(F.col("src").alias("key"), F.lit("src").alias("as")), F.struct(F.col("dst").alias("key"), F.lit("dst").alias("as"))))
    (nt, nm), (et, em) = marks(F.col("json")), marks(F.col("json"))
    node = node.select(F.col("id").alias("key"), F.lit("node").alias("as"), (F.col("kind") != "file").alias("flag"), "times", nt.alias("total"), nm.alias("mixed"))
    edge = merged_edges(edges).select("src", "dst", F.col("kind").isin("imports", "requires").alias("flag"), "times", et.alias("total"), em.alias("mixed"))
    edge = edge.select(end.alias("end"), "flag", "times", "total", "mixed").select("end.key", "end.as", "flag", "times", "total", "mixed")
    when = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0).cast("long"))
    is_, flag = lambda x: F.col("as") == x, F.col("flag")
    sums = {f"{when_} {what}": when(cond, n) for when_, n in (("before", F.col("times")), ("after", one)) for what, cond in (("node", is_("node")), ("src", is_("src")), ("import", is_("src") & flag), ("dst", is_("dst")))}
    sums |= {f"{x} total": when(is_(at), F.col("total")) for x, at in (("nodes", "node"), ("edges", "src"))}
    sums |= {f"{x} mixed": F.coalesce(F.bit_xor(F.when(is_(at), F.col("mixed"))), F.lit(0).cast("long")) for x, at in (("nodes", "node"), ("edges", "src"))}
    sums["other"] = F.coalesce(F.max(is_("node") & flag), F.lit(False))
    ids = node.unionByName(edge).groupBy("key").agg(*[c.alias(name) for name, c in sums.items()])
    unknown = F.col("key").isNull() | (F.col("after node") == 0)
    broken = {"src": (unknown, "src"), "dst": (unknown, "dst"), "import-source": (~unknown & F.col("other"), "import")}
    found = {f"{w} {rule}": when(cond, F.col(f"{w} {of}")) for w in ("before", "after") for rule, (cond, of) in broken.items()}
    found |= {f"{w} duplicate-id": when(F.col(f"{w} node") > 1, one) for w in ("before", "after")}
    prints = {"nodes": "after node", "edges": "after src"}
    for what, count in prints.items():
        mixed = F.coalesce(F.bit_xor(F.col(f"{what} mixed")), F.lit(0).cast("long"))
        found |= {f"{what} n": when(F.lit(True), F.col(count)), f"{what} total": when(F.lit(True), F.col(f"{what} total")), f"{what} mixed": mixed}
    told = ids.agg(*[c.alias(name) for name, c in found.items()])
    none = F.lit(None).cast("long")
    shown = [F.struct(F.lit(name).alias("what"), F.col(name).alias("n"), none.alias("total"), none.alias("mixed")) for name in found if name.split()[0] in ("before", "after")]
    kept = F.filter(F.array(*shown), lambda r: r["n"] > 0)
    own = [F.struct(F.lit(x).alias("what"), F.col(f"{x} n").alias("n"), F.col(f"{x} total").alias("total"), F.col(f"{x} mixed").alias("mixed")) for x in prints]
    return told.select(F.inline(F.concat(kept, F.array(*own))))


def surviving_ids(edges: DataFrame) -> DataFrame:
    """old, id: the edge that each edge became."""
    e = with_identity(edges).select(F.col("id").alias("old"), "identity")
    return e.join(e.groupBy("identity").agg(F.min("old").alias("id")), "identity").select("old", "id")


def remap_diagnostics(diagnostics: DataFrame, ids: DataFrame) -> DataFrame:
    """Diagnostics with their edge_id led to the edge that stayed, each once; one that names no edge is left."""
    map_ = ids.select(F.col("old").alias("edge_id"), F.col("id").alias("__new"))
    return diagnostics.join(map_, "edge_id", "left").withColumn("edge_id", F.coalesce("__new", "edge_id")).drop("__new").distinct().select(diagnostics.columns)


def metrics(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: how many of each a canonical graph holds."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(nodes, "node_count").crossJoin(n(edges, "edge_count")).crossJoin(n(diagnostics, "diagnostic_count"))  # one row each


def unique_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in an order: one partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(rows.columns)


def capped(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int, max_diagnostics: int = 10_000, diagnostics: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph cut to its limits in canonical order: nodes, edges whose ends both stayed, and diagnostics, of which
    one more says that the graph was cut."""
    n = first_n(nodes, [F.concat("id", F.lit('"'))], max_nodes)
    ends = n.select("id")
    e = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = first_n(e, [F.col("src"), F.col("dst"), F.col("kind")], max_edges)
    cut = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("e"))).filter((F.col("n") > max_nodes) | (F.col("e") > max_edges))
    said = cut.select(F.lit("GRAPH_TRUNCATED").alias("code"), F.lit("warning").alias("severity"))
    if diagnostics is not None:
        said = first_n(diagnostics.select("code", "severity"), [F.col("code"), F.col("severity")], max_diagnostics - 1).unionByName(said)
    return n, e, said
