"""Modules and names that imports stand for."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolve as M

FILE = "path string, content string"
PATHS = ["src/a.ts", "src/b.tsx", "src/b.ts", "src/dir/index.ts", "src/c.js", "src/c.d.ts", "src/core/x.ts", "src/lib/y.ts", "pkg/ui/src/main.ts", "pkg/ui/src/button.ts", "pkg/api/index.ts", "pkg/api/types.d.ts"]
CONFIG = """{
  // paths of this repository
  "compilerOptions": { "baseUrl": "./src", /* where they begin */
    "paths": { "@/*": ["*"], "@/core/*": ["core/*", "lib/*"], "exact": ["a.ts"], "odd": [1], "url": ["http://x"], },
  },
}"""


@pytest.fixture(scope="module")
def found(spark):
    ui = {"name": "@acme/ui", "exports": {".": {"import": "./src/main.ts", "require": ["./src/none.js"]}, "./button": "./src/button.ts"}}
    files = [("tsconfig.json", CONFIG), ("pkg/tsconfig.json", '{"compilerOptions": {"paths": {}}}'), ("bad/tsconfig.json", "{"), ("pkg/ui/package.json", json.dumps(ui)), ("pkg/api/package.json", '{"name": "api", "types": "types.d.ts"}'), ("pkg/odd/package.json", "no json")]
    f = spark.createDataFrame(files, FILE)
    asked = [("src/a.ts", s) for s in ("./b", "./c.js", "./dir", "../x", "../../out", "/src/a.ts", "@acme/ui", "@acme/ui/button", "@acme/ui/none", "api", "@/core/x", "@/core/none", "exact", "dir", "lib/y", "react/jsx", "@scope/x/y")] + [("pkg/z.ts", "dir"), ("pkg/z.ts", "@/core/x")]
    out = M.resolve_modules(spark.createDataFrame(asked, "importer string, specifier string"), spark.createDataFrame([(p,) for p in PATHS], "path string"), M.module_configs(f), M.workspace_packages(f))
    return {(r["importer"], r["specifier"]): (r["resolution"], r["candidates"], r["package"]) for r in out.collect()}


def test_every_way(found):
    a = lambda s: found["src/a.ts", s]
    assert a("./b") == ("ambiguous", ["src/b.ts", "src/b.tsx"], None)
    assert a("./c.js") == ("ambiguous", ["src/c.d.ts", "src/c.js"], None)
    assert a("./dir") == ("resolved", ["src/dir/index.ts"], None)
    assert a("../x")[0] == a("../../out")[0] == "unresolved"
    assert a("/src/a.ts") == ("resolved", ["src/a.ts"], None)
    assert a("@acme/ui") == ("resolved", ["pkg/ui/src/main.ts"], None)
    assert a("@acme/ui/button") == ("resolved", ["pkg/ui/src/button.ts"], None)
    assert a("@acme/ui/none") == ("unresolved", [], "@acme/ui")
    assert a("api") == ("resolved", ["pkg/api/types.d.ts"], None)
    assert a("@/core/x") == ("resolved", ["src/core/x.ts"], None)
    assert a("@/core/none") == ("unresolved", [], None)
    assert a("exact") == ("resolved", ["src/a.ts"], None)
    assert a("dir") == ("resolved", ["src/dir/index.ts"], None)
    assert a("lib/y") == ("resolved", ["src/lib/y.ts"], None)
    assert a("react/jsx") == ("external", [], "react")
    assert a("@scope/x/y") == ("external", [], "@scope/x")
    assert found["pkg/z.ts", "dir"] == ("external", [], "dir")
    assert found["pkg/z.ts", "@/core/x"] == ("external", [], "@/core")


def test_configurations(spark):
    rows = M.module_configs(spark.createDataFrame([("a/tsconfig.json", CONFIG), ("tsconfig.json", '{"x": 1}')], FILE)).collect()
    assert {r["pattern"] for r in rows} == {None, "@/*", "@/core/*", "exact", "url"} and {r["base_url"] for r in rows} == {"a/src"}
    assert next(r["targets"] for r in rows if r["pattern"] == "url") == ["http://x"]


def test_names(spark):
    symbols = spark.createDataFrame([("t.ts", "f", "t2", 2), ("t.ts", "f", "t1", 1), ("a.ts", "g", "a1", 1), ("t.ts", "g", "t3", 3)], "path string, name string, id string, place int")
    imports = spark.createDataFrame([("a.ts", "h", "t.ts", "f"), ("a.ts", "g", "t.ts", "g")], "path string, name string, target string, imported string")
    uses = spark.createDataFrame([("a.ts", "h"), ("a.ts", "g"), ("a.ts", "none"), ("t.ts", "f")], "path string, name string")
    assert {(r["path"], r["name"]): r["id"] for r in M.resolve_names(uses, imports, symbols).collect()} == {("a.ts", "h"): "t1", ("a.ts", "g"): "a1", ("a.ts", "none"): None, ("t.ts", "f"): "t1"}


def test_dispatch(spark):
    files = spark.createDataFrame([("a.ts",), ("b.md",)], "path string")
    assert M.dispatch(files, {"ts": r"\.ts\z", "py": r"\.py\z"}) == "ts" and M.dispatch(files, {"py": r"\.py\z"}) == "py"
    with pytest.raises(ValueError, match="md, ts"):
        M.dispatch(files, {"ts": r"\.ts\z", "md": r"\.md\z"})
    with pytest.raises(ValueError, match="no parser"):
        M.dispatch(files, {"go": r"\.go\z", "py": r"\.py\z"})


def test_attempts(spark):
    got = spark.createDataFrame([("a",), ("a.js",), ("a.ts",)], "p string").select(M.attempts(F.col("p")).alias("x")).collect()
    assert [len(r["x"]) for r in got] == [19, 6, 1]
