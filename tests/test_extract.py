"""Scans of file text, line by line."""

from graphloom.operators import extract as E

FILE = "path string, content string"


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("path", "line").collect()]


def test_findings_by_line(spark):
    texts = [
        'password = "abcdefgh1"',
        "a test line\npassword = 'abcdefgh1'",
        'password = "abcdefgh1"\r\nwrite to a@mail2.example.com',
        'token: "abcdefgh1" # placeholder',
        'token: "abcdefgh1" # placeholder\nsecret: "abcdefgh2"',
        "password = abcdefgh1",
        'api-key="short"',
        'api-key = "long enough" + eval (x)',
        "evaluate(x) new  Function(y)",
        "",
        None,
    ]
    files = spark.createDataFrame([(f"{i:02}", t) for i, t in enumerate(texts)], FILE)
    secret, dynamic = "Possible hard-coded credential", "Dynamic code execution"
    assert sorted(rows(E.findings(files), "path", "line", "title")) == [("00", 1, secret), ("01", 2, secret), ("02", 1, secret), ("04", 2, secret), ("07", 1, dynamic), ("07", 1, secret)]


def test_symbols_take_the_first_keyword_of_the_line(spark):
    code = "const a = 1\n  let $b = 2\nexport async function run$1() {\nexport const enum Color {\nenum E {\ntype _T = string\nexport class C {\ninterface I {\nconstant x\noutlet y\nclass A { type b"
    got = rows(E.symbols(spark.createDataFrame([("f.ts", code)], FILE)), "line", "kind", "name")
    assert got == [(1, "const", "a"), (2, "let", "$b"), (3, "function", "run$1"), (4, "const", "enum"), (6, "type", "_T"), (7, "class", "C"), (8, "interface", "I"), (10, "let", "y"), (11, "class", "A")]


def test_routes_of_all_forms(spark):
    code = "app.GET('/a', f)\nRouter.post (\n  app.put ( \"/b\", f)\nrouter.delete(`/c/${id}`, f)\nsubrouter.patch('/d')\napp.use('/e')\napp.get(x)"
    got = rows(E.routes(spark.createDataFrame([("f.ts", code)], FILE)), "line", "method", "route")
    assert got == [(1, "GET", "/a"), (3, "PUT", "/b"), (4, "DELETE", "/c/${id}"), (5, "PATCH", "/d")]


def test_dependencies_of_the_first_manifest(spark):
    manifest = '{"dependencies": {"express": "4", "@a/b": "1"}, "devDependencies": {"jest": "2", "express": "3"}}'
    files = [("a/package.json", manifest), ("b/package.json", '{"dependencies": {"late": "1"}}'), ("x.ts", "import q from 'q/sub'; require('./own'); from '@s/t/u'")]
    assert {r["package"] for r in E.dependencies(spark.createDataFrame(files, FILE)).collect()} == {"express", "@a/b", "jest", "q", "@s/t"}
    assert {r["package"] for r in E.dependencies(spark.createDataFrame([("package.json", "{broken")], FILE)).collect()} == set()


def test_sql_bodies_end_at_the_last_bracket_before_the_semicolon(spark):
    sql = '-- x\nCREATE TABLE IF NOT EXISTS "users" (\n id INT, price DECIMAL(10,2),\n PRIMARY KEY (id));\ncreate table `b` (a int) x (c int);\nCREATE TABLE none;\nCREATE TABLE c (\n  x int\n);'
    got = rows(E.sql_tables(spark.createDataFrame([("a.sql", sql), ("b.sql", None)], FILE)), "line", "name", "fields")
    assert got == [(2, "users", ["id", "price", "2)"]), (5, "b", ["a"]), (7, "c", ["x"])]


def test_knowledge_of_texts(spark):
    files = [("docs/a.md", "# One\ntext\n## Two\n#### no\n// NOTE: why not"), ("db/s.sql", "CREATE TABLE t (a int);CREATE TABLE t (b int)"), ("x.ts", "// hack: " + "y" * 40), ("e.md", "")]
    nodes, edges = E.knowledge(spark.createDataFrame(files, FILE))
    got = {r["id"]: r for r in nodes.collect()}
    assert sorted(got) == ["document:docs/a.md", "document:docs/a.md#line-1", "document:docs/a.md#line-3", "document:e.md", "file:db/s.sql", "schema:db/s.sql:t", "symbol:docs/a.md:rationale-5", "symbol:x.ts:rationale-1"]
    assert got["symbol:x.ts:rationale-1"]["name"] == "HACK: " + "y" * 30 and got["schema:db/s.sql:t"]["fields"] == ["a"]
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [("document:docs/a.md", "document:docs/a.md#line-1"), ("document:docs/a.md", "document:docs/a.md#line-3"), ("file:db/s.sql", "schema:db/s.sql:t"), ("file:docs/a.md", "symbol:docs/a.md:rationale-5"), ("file:x.ts", "symbol:x.ts:rationale-1")]


def test_blobs(spark):
    blobs = spark.createDataFrame([("aGVs\nbG8=", "base64"), ("aGVsbG8", "base64"), ("é", "utf-8"), ("AAE=", "base64"), ("/w==", "base64"), (None, "utf-8"), ("x", "odd")], "content string, encoding string")
    out = blobs.select(E.decode_blob(blobs.content, blobs.encoding).alias("b")).select("b", E.admissible_bytes(E.F.col("b")).alias("text")).collect()
    assert [bytes(r["b"]) if r["b"] is not None else None for r in out] == [b"hello", None, "é".encode(), b"\0\1", b"\xff", None, None]
    assert [r["text"] for r in out] == [True, False, True, False, False, False, False]
