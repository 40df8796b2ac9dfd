"""Impact of a change set of all labels."""

import os
import random

import duckdb
import pytest

from graphloom.operators import reports as R
from graphloom.plans import catalogue, graph_queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@tables
def test_changes_of_all_labels(spark, con):
    want = con.execute("SELECT count(*) FROM labels JOIN part ON doc_id = p_partkey").fetchone()[0]
    assert graph_queries.changes(spark, SF).count() == want > 0


@tables
@pytest.mark.parametrize("name", ["pr_direct_nodes", "pr_transitive", "pr_affected", "pr_risk"])
def test_results_of_all_labels(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(found, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_change_impact_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    path = {i: f"p{rnd.randrange(8)}" for i in ids}
    edges = sorted({(rnd.choice(ids), rnd.choice(ids), rnd.choice(["calls", "imports", "contains", "declares"])) for _ in range(30)})
    changed = {"p0", "p3", "none"}
    want = {i: 0 for i in ids if path[i] in changed}
    for depth in range(1, 5):
        for a in {a for a, b, kind in edges if kind in ("calls", "imports") and want.get(b) == depth - 1} - set(want):
            want[a] = depth
    nodes = spark.createDataFrame(list(path.items()), "id string, path string")
    changes = spark.createDataFrame([(p, "modified") for p in sorted(changed)] * 2, "path string, status string")
    got = R.change_impact(nodes, spark.createDataFrame(edges, "src string, dst string, kind string"), changes).collect()
    assert len(got) == len(want) and {r["id"]: r["depth"] for r in got} == want
