"""Every registered query of the code-graph library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if isinstance(v, bool) else v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(at) == len(found.description)
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
