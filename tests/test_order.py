"""Orders dealt into ranges: places, pages that read few ranges, first rows, and the tree as it is shown."""

import random

from pyspark.sql import functions as F

from graphloom.operators import ranks, reports
from graphloom.operators import resolve as M
from graphloom.operators import tree as T


def test_places_and_pages(spark):
    rnd = random.Random(1)
    values = [(rnd.choice("abcdef") * rnd.randint(1, 4), rnd.randint(0, 50)) for _ in range(700)] + [("zz", None), (None, 3)]
    rows = spark.createDataFrame(values, "k string, v int").repartition(5)
    index = ranks.RankIndex(rows, [F.col("k"), F.col("v")], range_rows=60)
    key = lambda t: ((t[0] is not None, t[0] or ""), (t[1] is not None, t[1] or 0))
    want = sorted(values, key=key)
    got = index.page().orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(702)) and [(r["k"], r["v"]) for r in got] == want
    for cursor, size in ((0, 10), (55, 90), (690, 50), (701, 1), (702, 5), (900, 5), (3, 0)):
        page = index.page(cursor, size)
        assert [(r["k"], r["v"]) for r in page.orderBy("pos").collect()] == want[cursor : cursor + size]
    assert len(index.parts) > 6
    read = {f.split("__part=")[1].split("/")[0] for f in index.page(300, 20).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert 1 <= len(read) <= 2  # a page reads the ranges that it meets
    assert ranks.RankIndex(rows.limit(0), [F.col("k")]).page(0, 5).count() == 0


def test_places_over_many_ranges(spark):
    """the places before each range were an expression nested as deep as there are ranges."""
    index = ranks.RankIndex(spark.range(400).select((F.lit(399) - F.col("id")).alias("k")), [F.col("k")], range_rows=1)
    assert len(index.parts) > 200
    assert sorted((r["pos"], r["k"]) for r in index.page().collect()) == [(i, i) for i in range(400)]
    assert sorted((r["pos"], r["k"]) for r in index.page(150, 100).collect()) == [(i, i) for i in range(150, 250)]
    assert index.page(400, 5).count() == 0 and index.page().columns == ["k", "pos"]


def test_first_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE_KEYS", 60)
    values = list(range(1000))
    random.Random(2).shuffle(values)
    rows = spark.createDataFrame([(v, f"k{v:04d}") for v in values], "v int, k string").repartition(4)
    for n in (0, 1, 7, 100, 730, 999, 1000, 5000):
        assert sorted(r["v"] for r in ranks.first_n(rows, [F.col("k")], n, range_rows=50).collect()) == list(range(min(n, 1000)))
    same = spark.createDataFrame([("x", i) for i in range(300)], "k string, v int")
    assert ranks.first_n(same, [F.col("k")], 20).count() == 20


def plain_tree(paths):
    """(path, kind, files) by a recursive walk."""
    root: dict = {}
    for p in paths:
        at = root
        for name in filter(None, p.split("/")):
            at = at.setdefault(name, {})
    out = []

    def walk(at, above):
        n = 0
        for name, below in sorted(at.items(), key=lambda x: (not x[1], x[0])):
            place = len(out)
            out.append(None)
            files = walk(below, f"{above}{name}/") if below else 1
            out[place] = (above + name, "folder" if below else "file", files, place, len(out) - 1)
            n += files
        return n

    walk(root, "")
    return out


def test_tree(spark):
    rnd = random.Random(5)
    paths = ["/".join(rnd.choice(["a", "b", "B", "_z", ".a", "é", "a.b"]) for _ in range(rnd.randint(1, 5))) for _ in range(150)] + ["x//y", "/lead", "b", "b"]
    got = T.ordered_tree(spark.createDataFrame([(p,) for p in paths], "path string"), range_rows=20).orderBy("place").collect()
    assert [(r["path"], r["kind"], r["files"], r["place"], r["last"]) for r in got] == plain_tree(paths)
    assert all(r["name"] == r["path"].split("/")[-1] and r["depth"] == r["path"].count("/") + 1 for r in got)
    one = T.matches(spark.createDataFrame([("A/b",), ("a/c",), ("x",), ("x",)], "path string"), "A/").first()
    assert tuple(one) == (2, 3)
    assert T.ordered_tree(spark.createDataFrame([], "path string")).count() == 0


def test_first_edges_of_a_walk(spark):
    """Nodes, distances and edge kinds as a queue meets them."""
    rnd = random.Random(8)
    for _ in range(4):
        ids = [f"n{i:02d}" for i in range(30)]
        edges = {(rnd.choice(ids), rnd.choice(ids), rnd.choice(["calls", "imports", "contains", "tests"])) for _ in range(70)}
        nodes = spark.createDataFrame([(i, "symbol", i, f"f{k % 9}") for k, i in enumerate(ids)], "id string, kind string, name string, path string")
        changes = spark.createDataFrame([("f1",), ("f4",)], "path string")
        queue = [(i, 0) for k, i in enumerate(ids) if k % 9 in (1, 4)]
        met, seen = {}, {i for i, _ in queue}
        while queue:
            at, distance = queue.pop(0)
            for src, _, kind in sorted(e for e in edges if e[1] == at and e[2] != "contains") if distance < 4 else []:
                if src not in seen:
                    seen.add(src)
                    met[src] = (distance + 1, kind)
                    queue.append((src, distance + 1))
        table = spark.createDataFrame(sorted(edges), "src string, dst string, kind string").repartition(3)
        got = {r["node_id"]: (r["distance"], r["via_edge_kind"]) for r in reports.transitive_impacts(nodes, table, changes).collect()}
        assert got == met


def test_risk_factors(spark):
    nodes = spark.createDataFrame([("a", "symbol", "a", "f0", True), ("r", "route", "r", "f9", None)], "id string, kind string, name string, path string, exported boolean")
    reached = spark.createDataFrame([("a", 0), ("r", 1)], "id string, depth int")
    changes = lambda n, gone: spark.createDataFrame([(n - i, f"f{i}", "deleted" if i < gone else "added") for i in range(n)], "place int, path string, status string")
    few = reports.risk_factors(nodes, changes(2, 1), reached).orderBy("place").collect()
    assert [(r["title"], r["score"], r["reason"]) for r in few] == [("File Deletions", 10, "1 file(s) deleted: f0"), ("Exported Interface Changes", 10, "1 exported symbol(s) modified"), ("API Endpoint Impact", 15, "1 HTTP route(s) in blast radius")]
    many = reports.risk_factors(nodes, changes(16, 5), reached).orderBy("place").collect()
    assert [(r["title"], r["score"], r["reason"]) for r in many][:2] == [("Large PR Scope", 25, "16 files modified in PR"), ("File Deletions", 30, "5 file(s) deleted: f4, f3, f2")]
    assert reports.risk_factors(nodes.limit(0), changes(1, 0), reached).count() == 0


def test_members_of_namespaces(spark):
    symbols = spark.createDataFrame([("t", "f", "2", 2, None), ("t", "f", "1", 1, None), ("t", "g", "3", 0, "C"), ("u", "f", "9", 0, None)], "path string, name string, id string, place int, parent string")
    spaces = spark.createDataFrame([("a", "ns", "t"), ("b", "ns", "s"), ("b", "ns", "u")], "path string, name string, target string")
    uses = spark.createDataFrame([("a", "ns", "f"), ("a", "ns", "g"), ("a", "no", "f"), ("b", "ns", "f"), ("c", "ns", "f")], "path string, qualifier string, name string")
    got = {(r["path"], r["qualifier"], r["name"]): r["id"] for r in M.resolve_members(uses, spaces, symbols).collect()}
    assert got == {("a", "ns", "f"): "1", ("a", "ns", "g"): None, ("a", "no", "f"): None, ("b", "ns", "f"): "9", ("c", "ns", "f"): None}


def test_orders_of_text(spark):
    from graphloom.functions.order import edge_order, order_key

    rows = spark.createDataFrame([(x,) for x in ["_z", "-a", ".a", "a", "A", "b", "B", "á", "a b", "ab", "1", "10", "2"]], "x string").repartition(3)
    told = lambda mode: [r["x"] for r in rows.orderBy(*order_key("x", mode=mode)).collect()]
    assert told("binary") == sorted(r["x"] for r in rows.collect())
    assert told("locale") == ["_z", "-a", ".a", "1", "10", "2", "a", "A", "á", "a b", "ab", "b", "B"]
    edges = spark.createDataFrame([("e2", "a", "b"), ("E1", "z", "b"), ("e10", "b", "b"), (None, "e1", "c")], "id string, src string, dst string").withColumn("kind", F.lit("calls"))
    by = lambda mode, e=edges: [r["src"] for r in e.orderBy(*edge_order(e, mode)).collect()]
    assert by("binary") == ["z", "e1", "b", "a"] and by("locale") == ["z", "b", "e1", "a"]
    assert by("binary", edges.drop("id")) == ["a", "b", "e1", "z"]


def test_pages_and_budgets_in_other_orders(spark):
    from graphloom.functions.order import edge_order
    from graphloom.operators import graph as G

    edges = spark.createDataFrame([("e2", "a", "x"), ("E1", "b", "x"), ("e1", "c", "x"), ("e3", "x", "d")], "id string, src string, dst string").withColumn("kind", F.lit("calls"))
    page = lambda **k: [r["id"] for r in G.neighbors(edges, "x", **k).collect()]
    assert page() == ["e2", "E1", "e1", "e3"] and page(order=edge_order(edges, "locale"), cursor=1, max_results=2) == ["E1", "e2"]
    met = lambda **k: {r["id"] for r in G.budgeted_levels(edges, "x", "both", None, 1, max_cost=2, **k)[0].collect()}
    assert met() == {"x", "a", "b"} and met(order=edge_order(edges, "locale")) == {"x", "b", "c"}


def test_file_details(spark):
    nodes = spark.createDataFrame([("s", "symbol", "S", "f"), ("r", "route", "R", "f"), ("t", "symbol", "T", "g"), ("p", "package", "P", None)], "id string, kind string, name string, path string")
    edges = spark.createDataFrame(
        [("e1", "s", "t", "calls", 3), ("e2", "s", "t", "calls", 4), ("e3", "t", "r", "tests", None), ("e4", "s", "r", "calls", 1), ("e5", "t", "s", "declares", 1), ("e6", "r", "p", "imports", 9), ("e7", "s", "gone", "calls", 1)],
        "id string, src string, dst string, kind string, line int",
    )
    got = [tuple(r[c] for c in ("what", "id", "direction", "name", "line")) for r in reports.file_details(nodes, edges, "f").orderBy("place").collect()]
    want = [("symbol", "s", None, "S", None), ("route", "r", None, "R", None), ("relationship", "e3", "incoming", "T", None), ("relationship", "e1", "outgoing", "T", 3), ("relationship", "e2", "outgoing", "T", 4), ("relationship", "e6", "outgoing", "P", 9)]
    assert got == want
    assert reports.file_details(nodes, edges, "none").count() == 0


def test_assembly_is_stable(spark):
    """The same graph from any order of its rows, and from rows that come twice; another graph has another fingerprint."""
    from graphloom.operators import canonical as K

    rnd = random.Random(4)
    nodes = [(f"n{i}", "file", f"N{i}", f"p{i}", None, None, None) for i in range(40)]
    shape = "id string, kind string, name string, path string, symbol_kind string, exported boolean, method string"
    edges = [(f"e{i}", f"n{i % 7}", f"n{i % 5}", "calls", "EXTRACTED", 1.0, [f"x{i % 3}"], None, None, None, None, []) for i in range(60)]
    edge = "id string, src string, dst string, kind string, provenance string, confidence double, evidence array<string>, mode string, specifier string, type_only boolean, resolution string, candidates array<string>"

    def report(n, e, parts):
        one, merged, told = K.assemble(spark.createDataFrame(n, shape).repartition(parts), spark.createDataFrame(e, edge).repartition(parts))
        return {r["what"]: (r["n"], r["total"], r["mixed"]) for r in told.collect()}

    plain = report(nodes, edges, 1)
    assert set(plain) == {"nodes", "edges"} and plain["nodes"][0] == 40 and plain["edges"][0] == 35
    mixed = rnd.sample(nodes, 40) + nodes[:9], rnd.sample(edges, 60) + edges[5:30]
    again = report(*mixed, 5)
    assert again.pop("before duplicate-id")[0] == 9 and again == plain
    assert report(nodes, edges[:-1] + [(*edges[-1][:3], "tests", *edges[-1][4:])], 3)["edges"] != plain["edges"]
    assert report(nodes[:-36], edges, 2)["after src"][0] > 0


def test_assembly_reads_each_side_once(spark):
    """the report shuffled all edges over and over: for joins with nodes before and after, and for each branch of the merge."""
    from graphloom.operators import canonical as K

    shape = "id string, kind string, name string, path string, symbol_kind string, exported boolean, method string"
    edge = "id string, src string, dst string, kind string, provenance string, confidence double, evidence array<string>, mode string, specifier string, type_only boolean, resolution string, candidates array<string>"
    nodes = [(i, kind, "N", None, None, None, None) for i, kind in (("a", "file"), ("b", "route"), ("b", "route"), ("c", "file"), ("c", "schema"), (None, "file"))]
    rest = ("calls", "EXTRACTED", None, None, None, None)
    edges = [
        ("e1", "a", "b", "imports", "EXTRACTED", 0.0, ["y", "x", "x"], "static", "s", True, "resolved", ["b", "a"]),
        ("e0", "a", "b", "imports", "EXTRACTED", -0.0, ["z"], "static", "s", True, "resolved", ["a", "b", "a"]),
        ("e2", "b", "a", "imports", "EXTRACTED", 1.0, [], "static", "s", True, "resolved", []),
        ("e3", "none", "a", *rest[:2], 1.0, None, *rest[2:], None),
        ("e3", "none", "a", *rest[:2], 1.0, [], *rest[2:], None),
        ("e4", "c", "gone", *rest[:2], 1.0, ["x"], *rest[2:], None),
        ("e5", None, "a", *rest[:2], None, ["x"], *rest[2:], None),
    ]
    one, merged, told = K.assemble(spark.createDataFrame(nodes, shape).repartition(3), spark.createDataFrame(edges, edge).repartition(2))
    plan = told._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 2 and "Join" not in plan.toString()
    json = {r["id"]: r["json"] for r in merged.collect()}
    assert json["e0"] == '{"confidence":0,"evidence":["x","y","z"],"from":"a","id":"e0","kind":"imports","metadata":{"candidates":["a","b"],"mode":"static","resolution":"resolved","specifier":"s","typeOnly":true},"provenance":"EXTRACTED","to":"b"}'
    assert json["e3"] == '{"confidence":1,"evidence":[],"from":"none","id":"e3","kind":"calls","provenance":"EXTRACTED","to":"a"}'
    assert set(json) == {"e0", "e2", "e3", "e4", "e5"} and one.count() == 5
    found = {r["what"]: r["n"] for r in told.collect()}
    broken = {"src": (3, 2), "dst": (1, 1), "import-source": (1, 1), "duplicate-id": (2, 1)}
    assert found == {"nodes": 5, "edges": 5, **{f"{w} {rule}": n[i] for rule, n in broken.items() for i, w in enumerate(("before", "after"))}}
    empty = K.assemble(spark.createDataFrame([], shape), spark.createDataFrame([], edge))[-1]
    assert sorted(tuple(r) for r in empty.collect()) == [("edges", 0, 0, 0), ("nodes", 0, 0, 0)]
