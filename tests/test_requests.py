"""JSON requests: how often a plan reads a body, and odd bodies."""

import re

import pytest

from graphloom.operators import requests as R

BODIES = [
    (1, '{"type":"search","text":"a"}'),
    (2, None),
    (3, ""),
    (4, "not json"),
    (5, '{"type":"node","nodeId":"n","budget":{"maxCost":0,"x":1}}'),
    (5, '{"type":"node","nodeId":"n","budget":{"maxCost":0,"x":1}}'),
    (None, '{"type":"node","cursor":1}'),
    (6, '{"type":["node"],"nodeId":"n"}'),
]


def parses(df) -> int:
    """How often the plan that runs parses a body."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"parseJson|parse_json", plan))


@pytest.fixture
def bodies(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    yield spark.createDataFrame(BODIES, "id int, body string").repartition(2)
    spark.conf.unset("spark.sql.maxPlanStringLength")
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_good_queries_are_parsed_once(bodies):
    """the filter for good queries was moved below the parsing and repeated it over a hundred times."""
    good = R.graph_queries(bodies, "id", "body").filter("query IS NOT NULL").select("id", "query.*")
    assert parses(good) == 1
    assert [(r["id"], r["type"], r["text"], r["max_cost"]) for r in good.collect()] == [(1, "search", "a", 10_000)]


def test_broken_rules_are_found_in_one_parse(bodies):
    """the rows that explode() would drop were looked for first, with all rules and all parses again."""
    broken = R.query_violations(bodies, "id", "body")
    assert parses(broken) == 1
    found = sorted(((r["id"], r["rule"]) for r in broken.collect()), key=str)
    objects = [(i, "object") for i in (2, 3, 4)]
    twice = [(5, "budget"), (5, "budget"), (5, "budget-key"), (5, "budget-key")]
    assert found == [*objects, *twice, (6, "type"), (None, "missing-key"), (None, "unknown-key")]
