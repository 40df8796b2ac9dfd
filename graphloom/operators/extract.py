"""Extraction from file text: table-generating scans that stay in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X

#: Patterns of the line scans.  \z rather than $, which also matches before a last line break.
IMPORT = r"""(?:from\s+|require\s*\(\s*)["']([^"']+)"""
SYMBOL = r"(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const|let)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
KEYWORD = r"function|class|interface|type|const|let"
ROUTE = r"""(?i)(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*["'`]([^"'`]+)"""
CREDENTIAL = r"""(?i)(?:password|token|secret|api[_-]?key)\s*[:=]\s*["'][^"']{8,}["']"""
HARMLESS = r"(?i)(process\.env|import\.meta\.env|example|placeholder|test)"
DYNAMIC = r"\beval\s*\(|new Function\s*\("
HEADING = r"\A(#{1,3})\s+([^\r\n]+)\z"
RATIONALE = r"(?i)//\s*(NOTE|WHY|HACK|ADR|TODO):\s*([^\r\n]+)\z"
TABLE = r"""(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:`|"|')?([a-zA-Z0-9_]+)(?:`|"|')?\s*\(([^;]+)\)"""
CONSTRAINT = r"(?i)\A(PRIMARY|FOREIGN|KEY|CONSTRAINT|INDEX|UNIQUE)"
TERM = r"\A[A-Z][A-Za-z]+\z"
#: Files that the code extractor reads, and those that configure it.
SUPPORTED = r"(?i)\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)\z"
CONFIGURES = r"(?:\A|/)(?:tsconfig|package)\.json\z"
#: Longest lists of a content model.
MODEL_EDGES, MODEL_SYMBOLS, MODEL_ROUTES, MODEL_TERMS = 800, 1_500, 300, 30


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text for each line of files(path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def imports(files: DataFrame) -> DataFrame:
    """Imports of each line; `require` if the line holds that word, and the package unless the specifier is a path."""
    found = lines(files).select("path", "line", F.when(F.col("text").contains("require"), "require").otherwise("import").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1))).alias("specifier"))
    outside = ~F.col("specifier").startswith(".") & ~F.col("specifier").startswith("/")
    return found.withColumn("package", F.when(outside, X.package_name(F.col("specifier"))))


def symbols(files: DataFrame) -> DataFrame:
    """The first declaration of each line; its kind is the first keyword that the line holds anywhere."""
    t = F.col("text")
    return lines(files).filter(t.rlike(SYMBOL)).select("path", "line", F.regexp_extract(t, KEYWORD, 0).alias("kind"), F.regexp_extract(t, SYMBOL, 1).alias("name"))


def routes(files: DataFrame) -> DataFrame:
    t = F.col("text")
    return lines(files).filter(t.rlike(ROUTE)).select("path", "line", F.upper(F.regexp_extract(t, ROUTE, 1)).alias("method"), F.regexp_extract(t, ROUTE, 2).alias("route"))


def findings(files: DataFrame) -> DataFrame:
    """path, line, title of lines that hold a credential and none of the words that excuse it, or that run
    text as code; a line may give both.  Texts without a hit anywhere aren't split."""
    t = F.col("text")
    some = files.filter(F.col("content").rlike(CREDENTIAL) | F.col("content").rlike(DYNAMIC))
    titles = F.array_compact(F.array(F.when(t.rlike(CREDENTIAL) & ~t.rlike(HARMLESS), "Possible hard-coded credential"), F.when(t.rlike(DYNAMIC), "Dynamic code execution")))
    return lines(some).select("path", "line", F.explode(titles).alias("title"))


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct packages that files import or that the first package.json (by path) names; one that is no
    JSON object, or has other values there, names none."""
    named = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")]))
    first = files.filter(F.col("path").rlike(r"(\A|/)package\.json\z")).agg(F.min_by("content", "path").alias("content"))
    return imports(files).select("package").filter("package IS NOT NULL").unionByName(first.select(F.explode(named).alias("package"))).distinct()


def terms(files: DataFrame, k: int = MODEL_TERMS) -> DataFrame:
    """The first k symbols, by path and line, whose names are words that begin with a capital."""
    return symbols(files).filter(F.col("name").rlike(TERM)).orderBy("path", "line").limit(k).select("name", "kind", "path", "line")


def headings(files: DataFrame) -> DataFrame:
    t = F.col("text")
    return lines(files).filter(t.rlike(HEADING)).select("path", "line", F.length(F.regexp_extract(t, HEADING, 1)).alias("level"), F.trim(F.regexp_extract(t, HEADING, 2)).alias("title"))


def rationale(files: DataFrame) -> DataFrame:
    """Comments that say why: kind in capitals, text and line."""
    t = F.col("text")
    return lines(files).filter(t.rlike(RATIONALE)).select("path", "line", F.upper(F.regexp_extract(t, RATIONALE, 1)).alias("tag"), F.trim(F.regexp_extract(t, RATIONALE, 2)).alias("note"))


def sql_tables(files: DataFrame) -> DataFrame:
    """path, pos (statement), line, name, fields of CREATE TABLE statements; a statement ends at a semicolon, its body at the last
    bracket before.  Columns are what stands between commas, without rows that state constraints."""
    parts = files.filter(F.col("content").rlike(TABLE)).select("path", F.posexplode(F.split("content", ";")).alias("pos", "part"))
    breaks = F.regexp_count("part", F.lit("\n"))
    before = F.coalesce(F.sum(breaks).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).filter(F.col("part").rlike(TABLE))
    head = F.substring("part", F.lit(1), F.regexp_instr("part", F.lit(TABLE)) - 1)
    columns = F.transform(F.split(F.regexp_extract("part", TABLE, 2), ","), lambda c: F.regexp_replace(F.regexp_extract(F.trim(F.regexp_replace(c, r"[\r\n\t]", " ")), r"\A(\S*)", 1), "[`\"']", ""))
    fields = F.filter(columns, lambda c: (c != "") & ~c.rlike(CONSTRAINT))
    return parts.select("path", "pos", (F.col("before") + F.regexp_count(head, F.lit("\n")) + 1).cast("int").alias("line"), F.regexp_extract("part", TABLE, 1).alias("name"), fields.alias("fields"))


#: Columns of the nodes and edges that texts give.
KNOWN_NODE = ("id", "kind", "name", "path", "line", "symbol_kind", "exported", "fields")
KNOWN_EDGE = ("id", "src", "dst", "kind", "rule", "path", "line")


def knowledge(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files(path, content): documents with their headings, SQL files with their tables,
    and comments of any file that say why.  Each id once."""
    none = lambda kind: F.lit(None).cast(kind)

    def node(df, **c):
        kinds = {"line": "int", "exported": "boolean", "fields": "array<string>"}
        return df.select(*[c.get(k, none(kinds.get(k, "string"))).alias(k) for k in KNOWN_NODE], c.get("pos", F.lit(0)).alias("pos"))

    def edge(df, src, dst, kind, rule):
        return df.select(F.concat(F.lit("edge:"), src, F.lit("->"), dst, F.lit(":"), F.lit(kind)).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), rule.alias("rule"), "path", "line", F.lit(0).alias("pos"))

    path = F.col("path")
    name = F.when(X.basename(path) == "", path).otherwise(X.basename(path))
    doc, file = F.concat(F.lit("document:"), path), F.concat(F.lit("file:"), path)
    md, sql = files.filter(path.endswith(".md")), files.filter(path.endswith(".sql"))
    titles, tables, notes = headings(md), sql_tables(sql), rationale(files)
    section = F.concat(doc, F.lit("#line-"), F.col("line").cast("string"))
    schema = F.concat(F.lit("schema:"), path, F.lit(":"), "name")
    note = F.concat(F.lit("symbol:"), path, F.lit(":rationale-"), F.col("line").cast("string"))
    nodes = [
        node(md, id=doc, kind=F.lit("file"), name=name, path=path),
        node(titles, id=section, kind=F.lit("symbol"), name=F.col("title"), path=path, line=F.col("line"), symbol_kind=F.lit("document-heading"), exported=F.lit(True)),
        node(sql, id=file, kind=F.lit("file"), name=name, path=path),
        node(tables, id=schema, kind=F.lit("schema"), name=F.col("name"), path=path, line=F.col("line"), fields=F.col("fields"), pos=F.col("pos")),
        node(notes, id=note, kind=F.lit("symbol"), name=F.concat("tag", F.lit(": "), F.substring("note", 1, 30)), path=path, line=F.col("line"), symbol_kind=F.lit("rationale-comment"), exported=F.lit(False)),
    ]
    edges = [
        edge(titles, doc, section, "contains", F.lit("markdown-heading")),
        edge(tables, file, schema, "declares", F.lit("sql-create-table")),
        edge(notes, file, note, "contains", F.lower("tag")),
    ]

    def once(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        rest = [c for c in out.columns if c not in ("id", "pos")]
        # of several with one id, as a table created twice, the first
        return out.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("line", "pos")).alias("r")).select("id", "r.*")

    return once(nodes), once(edges)


def enrich(nodes: DataFrame, edges: DataFrame, edge_id: Column, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with what its files' texts give: what has an id of the graph's own is left out, so the graph's
    wins.  Returns the nodes (id, kind, name, path) and edges (id, src, dst, kind) of both."""
    more_nodes, more_edges = knowledge(files)
    own = edges.withColumn("id", edge_id)
    n = nodes.select("id", "kind", "name", "path").unionByName(more_nodes.join(nodes.select("id"), "id", "left_anti").select("id", "kind", "name", "path"))
    e = own.select("id", "src", "dst", "kind").unionByName(more_edges.join(own.select("id"), "id", "left_anti").select("id", "src", "dst", "kind"))
    return n, e


def unsupported(files: DataFrame) -> DataFrame:
    """A warning for each file that the code extractor neither reads nor takes as configuration."""
    path = F.col("path")
    message = F.concat(F.lit("No TypeScript extractor support for analyzed source file "), path)
    return files.filter(~path.rlike(SUPPORTED) & ~path.rlike(CONFIGURES)).select(F.lit("SOURCE_FILE_UNSUPPORTED").alias("code"), F.lit("warning").alias("severity"), message.alias("message"), "path")


#: Paths of pages and handlers below app, and of handlers below pages/api, whatever their case.
APP_ROUTE = r"(?i)(?:\A|/)app(?:/(.*))?/(route|page)\.[cm]?[jt]sx?\z"
PAGES_ROUTE = r"(?i)(?:\A|/)pages/api/(.+)\.[cm]?[jt]sx?\z"


def next_route(path: Column) -> Column:
    """Route of a page or handler file by its path, as struct of route, api and page; null for other files.  Groups in
    brackets and slots with @ are no part of it, nor is a last /index."""
    parts = F.filter(F.split(F.regexp_extract(path, APP_ROUTE, 1), "/"), lambda s: (s != "") & ~s.rlike(r"\A\(.+\)\z") & ~s.rlike(r"\A@."))
    app = F.regexp_replace(F.concat(F.lit("/"), F.array_join(parts, "/")), r"/index\z", "")
    what = F.regexp_extract(path, APP_ROUTE, 2)
    pages = F.regexp_replace(F.concat(F.lit("/api/"), F.regexp_extract(path, PAGES_ROUTE, 1)), r"/index\z", "")
    shape = lambda route, api, page: F.struct(route.alias("route"), api.alias("api"), page.alias("page"))
    in_app = shape(F.when(app == "", "/").otherwise(app), what == "route", what == "page")
    return F.when(path.rlike(APP_ROUTE), in_app).when(path.rlike(PAGES_ROUTE), shape(pages, F.lit(True), F.lit(False)))


def admissible(content: Column) -> Column:
    """Whether text is no binary: no NUL, and few control characters."""
    controls = F.regexp_count(content, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return ~content.contains("\0") & (controls <= F.greatest(F.lit(1.0), F.length(content) / 100))


def admissible_bytes(content: Column) -> Column:
    """The same of bytes, which must be UTF-8 as well; null text is no text."""
    text = F.decode(F.when(F.is_valid_utf8(content), content), "UTF-8")
    return F.coalesce(admissible(text), F.lit(False))


def decode_blob(content: Column, encoding: Column) -> Column:
    """Bytes of a blob's text: UTF-8 as it stands, base64 after white space is dropped if what remains is well
    formed, else null."""
    bare = F.regexp_replace(content, r"\s", "")
    good = bare.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(encoding == "utf-8", content.cast("binary")).when((encoding == "base64") & good, F.unbase64(bare))


def content_model(files: DataFrame) -> dict[str, DataFrame]:
    """Lists of a content model by name, each cut to its longest length in file and line order."""
    return {
        "edges": imports(files).orderBy("path", "line", "specifier").limit(MODEL_EDGES),
        "symbols": symbols(files).orderBy("path", "line").limit(MODEL_SYMBOLS),
        "routes": routes(files).orderBy("path", "line").limit(MODEL_ROUTES),
        "dependencies": dependencies(files),
        "terms": terms(files),
        "security": findings(files).select("title", "path").distinct(),
    }
