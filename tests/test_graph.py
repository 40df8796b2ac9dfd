"""Graph queries on small graphs, and the sequential budget against a plain simulation."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import reports as R

EDGE = "src string, dst string, kind string"


@pytest.fixture(scope="module")
def cycle(spark):
    return spark.createDataFrame([("b", "c", "imports"), ("a", "b", "imports"), ("c", "a", "imports"), ("a", "alpha", "declares")], EDGE)


def test_impact_follows_a_cycle(cycle):
    assert {r["id"] for r in G.impact(cycle, "c", "incoming", ("imports",)).collect()} == {"a", "b", "c"}


def test_path_and_no_path(cycle):
    path = sorted((r["step"], r["id"]) for r in G.shortest_path(cycle, "a", "c", "outgoing", ("imports",)).collect())
    assert [i for _, i in path] == ["a", "b", "c"]
    assert G.shortest_path(cycle, "alpha", "c", "outgoing").count() == 0


def test_neighbours_page(cycle):
    first = G.neighbors(cycle, "a", cursor=0, max_results=1).collect()
    rest = G.neighbors(cycle, "a", cursor=1, max_results=5).collect()
    assert len(first) == 1 and len(rest) == 2 and G.neighbors(cycle, "none").count() == 0


def simulate(edges, source, direction, max_depth, max_cost, max_results, target):
    order = sorted(edges)
    seen, queue, cost = {source: 0}, [(source, 0)], 0
    while queue:
        node, depth = queue.pop(0)
        if depth >= max_depth:
            continue
        for a, b, _ in order:
            if cost >= max_cost:
                return seen, cost, "cost"
            cost += 1
            ends = []
            if direction != "incoming" and a == node:
                ends.append(b)
            elif direction != "outgoing" and b == node:
                ends.append(a)
            for n in ends:
                if n in seen:
                    continue
                if max_results is not None and len(seen) == max_results:
                    return seen, cost, "results"
                seen[n] = depth + 1
                queue.append((n, depth + 1))
                if n == target:
                    return seen, cost, None
    return seen, cost, None


@pytest.mark.parametrize("seed", range(6))
def test_budget_equals_simulation(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(rnd.choice("abcdefg"), rnd.choice("abcdefg"), "calls") for _ in range(rnd.randint(3, 14))})
    direction = rnd.choice(["outgoing", "incoming", "both"])
    depth, cost, results = rnd.randint(1, 4), rnd.randint(1, 60), rnd.choice([None, 2, 3, 5])
    target = None if results else rnd.choice("abcdefg")
    got, first, meta = G.budgeted_levels(spark.createDataFrame(edges, EDGE), "a", direction, None, depth, cost, results, None if target == "a" else target)
    want, used, reason = simulate(edges, "a", direction, depth, cost, results, None if target == "a" else target)
    assert {r["id"]: r["depth"] for r in got.collect()} == want
    assert meta["truncationReason"] == reason
    if reason:
        assert meta["cost"] == used


def test_answers_of_a_small_graph(spark):
    """Pages, envelopes, tree edges and paths of four nodes and their edges."""
    nodes = spark.createDataFrame([(i, "file" if i != "alpha" else "symbol", i, None, None, None) for i in ("a", "alpha", "b", "c")], "id string, kind string, name string, path string, symbol_kind string, method string")
    edges = spark.createDataFrame([("a", "alpha", "declares"), ("a", "b", "imports"), ("b", "c", "imports"), ("c", "a", "imports")], EDGE)
    e = lambda answer: answer[-1].first()
    found = G.answer_search(nodes, "ALPHA")
    assert [r["id"] for r in found[0].collect()] == ["alpha"] and (e(found)["cost"], e(found)["next_cursor"]) == (4, None)
    assert (e(G.answer_search(nodes, "a", max_results=1))["truncation_reason"], e(G.answer_search(nodes, "a", max_results=1))["next_cursor"]) == ("results", 1)
    cut = e(G.answer_search(nodes, "a", max_cost=1))
    assert (cut["cost"], cut["truncation_reason"], cut["next_cursor"]) == (1, "cost", None)
    page = G.answer_neighbors(nodes, edges, "a", max_results=1)
    assert e(page)["next_cursor"] == 1 and {r["id"] for r in page[0].collect()} == {"a", "alpha"}
    rest = G.answer_neighbors(nodes, edges, "a", cursor=1, max_results=5)
    assert e(rest)["next_cursor"] is None and rest[1].count() == 2
    assert [x.count() for x in G.answer_neighbors(nodes, edges, "none")[:2]] == [0, 0]
    met = G.answer_impact(nodes, edges, "c", "incoming", ("imports",))
    assert {r["id"] for r in met[0].collect()} == {"a", "b", "c"} and not e(met)["truncated"]
    assert [(r["src"], r["dst"]) for r in met[1].collect()] == [("b", "c"), ("a", "b")]
    assert e(G.answer_impact(nodes, edges, "none"))["cost"] == 1
    path = G.answer_path(nodes, edges, "a", "c", "outgoing", ("imports",))
    assert e(path)["path"] == ["a", "b", "c"] and path[1].count() == 2
    assert e(G.answer_path(nodes, edges, "a", "a"))["path"] == ["a"] and e(G.answer_path(nodes, edges, "alpha", "c", "outgoing"))["path"] is None
    assert e(G.answer_node(nodes, "b"))["nodes"] == 1 and e(G.answer_explain(nodes, edges, "a"))["edges"] == 3


def test_merge_is_stable_under_order(spark):
    rows = [("e2", "a", "b", "calls", "X", None, ["x"]), ("e1", "a", "b", "calls", "X", None, ["y", "x"]), ("e3", "a", "b", "calls", "X", 0.5, ["z"]), ("e4", "a", "c", "calls", "X", None, [])]
    schema = "id string, src string, dst string, kind string, provenance string, confidence double, evidence array<string>"
    one = R.merge_edges(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    two = R.merge_edges(spark.createDataFrame(rows[::-1], schema).repartition(3)).orderBy("id").collect()
    assert one == two and [(r["id"], r["evidence"]) for r in one] == [("e1", ["x", "y"]), ("e3", ["z"]), ("e4", [])]


def test_canonical_form_is_stable_and_idempotent(spark):
    from graphloom.operators import canonical as K

    schema = "id string, src string, dst string, kind string, provenance string, confidence double, evidence array<string>, mode string, specifier string, type_only boolean, resolution string, candidates array<string>"
    rows = [("e3", "a", "b", "imports", "X", 1.0, ["2"], "static", "./b", False, "ambiguous", ["q", "p"]), ("e2", "a", "b", "imports", "X", 1.0, ["1", "2"], "static", "./b", False, "ambiguous", ["p", "q", "p"]), ("e9", "a", "b", "calls", "X", 0.25, [], None, None, None, None, None)]
    one = K.canonical_edges(spark.createDataFrame(rows, schema)).orderBy("json").collect()
    two = K.canonical_edges(spark.createDataFrame(rows[::-1], schema).repartition(2)).orderBy("json").collect()
    assert one == two and [r["id"] for r in one] == ["e9", "e2"]
    assert one[1]["json"] == '{"confidence":1,"evidence":["1","2"],"from":"a","id":"e2","kind":"imports","metadata":{"candidates":["p","q"],"mode":"static","resolution":"ambiguous","specifier":"./b","typeOnly":false},"provenance":"X","to":"b"}'
    again = [("e2", "a", "b", "imports", "X", 1.0, ["1", "2"], "static", "./b", False, "ambiguous", ["p", "q"]), rows[2]]
    assert K.canonical_edges(spark.createDataFrame(again, schema)).orderBy("json").collect() == one
    assert {(r["old"], r["id"]) for r in K.surviving_ids(spark.createDataFrame(rows, schema)).collect()} == {("e3", "e2"), ("e2", "e2"), ("e9", "e9")}


def test_local_answers(spark):
    symbols = spark.createDataFrame([("loginUser", "src/a.ts", 3), ("Other", "src/auth.ts", 1), ("Gizmo", "src/g.ts", 7)], "name string, path string, line int")
    routes = spark.createDataFrame([("GET", "/x", "src/r.ts", 2)], "method string, route string, path string, line int")
    ask = lambda q: [tuple(r) for r in R.local_answer(q, symbols, routes).orderBy("place").collect()]
    assert ask("Is there a SESSION?") == [(1, "Authentication-related code found", "src/a.ts:3"), (2, "Authentication-related code found", "src/auth.ts:1")]
    assert ask("which endpoint") == [(1, "1 route definitions detected", "GET /x — src/r.ts")]
    assert ask("a gizmo!") == [(1, "1 relevant definitions found", "Gizmo — src/g.ts:7")]
    assert ask("nothing here") == [(0, "No supported answer found", None)]


def test_diagram_of_no_edges(spark):
    nodes = spark.createDataFrame([("a", "file", 'q"\\')], "id string, kind string, name string")
    none = spark.createDataFrame([("a", "a", "contains")], EDGE)
    assert [r["line"] for r in R.diagram_lines(nodes, none).orderBy("place").collect()] == ["graph TD", "  no_edges[No structural relationships found]"]
    own = spark.createDataFrame([("a", "a", "calls")], EDGE)
    assert [r["line"] for r in R.diagram_lines(nodes, own).orderBy("place").collect()] == ["graph TD", '  n_a["q\\"\\\\ (file)"]', '  n_a -->|"calls"| n_a']


def test_paths(spark):
    rows = spark.createDataFrame([("a/../b",), ("../x",), ("./a//b.TS",), ("",), (None,)], "p string")
    got = rows.select(X.resolve_dots(F.col("p")).alias("r"), X.extension(F.col("p")).alias("e"), X.safe_path(F.col("p")).alias("s")).collect()
    assert [r["r"] for r in got] == ["b", None, "a/b.TS", "", None]
    assert got[2]["e"] == "ts" and not any(r["s"] for r in got)


def test_greedy_budget_passes_over(spark):
    rows = spark.createDataFrame([(1, "a", 6), (1, "b", 6), (1, "c", 4), (2, "a", 11)], "k int, path string, size long")
    taken = {(r["k"], r["path"]) for r in R.greedy_budget(rows, "k", 10).collect() if r["taken"]}
    assert taken == {(1, "a"), (1, "c")}
