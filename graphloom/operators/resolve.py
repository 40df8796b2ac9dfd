"""Module resolution as joins: candidates, aliases and nearest configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X

#: Endings of modules in order, and of those that stand for typed ones.
ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")
SCRIPTS = (".js", ".jsx", ".mjs", ".cjs")
TYPED = (".ts", ".tsx", ".mts", ".cts", ".d.ts")
#: What a comment or a trailing comma is in configuration files, beside the strings that may hold either.
COMMENT = r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/'
COMMA = r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])'
#: Texts in JSON; those that a colon follows are keys.
TEXT = r'"(?:\\.|[^"\\])*"(?:\s*:)?'


def attempts(base: Column) -> Column:
    """Paths that a base may stand for, itself first: typed ones for a script's ending, all endings and index
    files for none."""
    ends = lambda known: _any([base.endswith(e) for e in known])
    stem = F.regexp_replace(base, r"\.(?:js|jsx|mjs|cjs)\z", "")
    scripts = F.when(ends(SCRIPTS), F.array(*[F.concat(stem, F.lit(e)) for e in TYPED]))
    bare = F.when(~ends(ENDINGS), F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS], *[F.concat(base, F.lit("/index" + e)) for e in ENDINGS]))
    none = F.array().cast("array<string>")
    return F.concat(F.array(base), F.coalesce(scripts, none), F.coalesce(bare, none))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def status(matches: Column) -> Column:
    return F.when(matches > 1, "ambiguous").when(matches == 1, "resolved").otherwise("unresolved")


def probe(specifiers: DataFrame, paths: DataFrame) -> DataFrame:
    """specifiers(base) against paths(path): base, matches, candidates (sorted) and status."""
    bases = specifiers.select("base").distinct()
    tries = bases.select("base", F.explode(F.array_distinct(attempts(F.col("base")))).alias("path"))
    hit = tries.join(paths.select("path").distinct(), "path").groupBy("base").agg(F.sort_array(F.collect_set("path")).alias("candidates"))  # 19 at most
    out = bases.join(hit, "base", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.withColumn("matches", F.size("candidates").cast("long")).withColumn("status", status(F.col("matches")))


def module_configs(files: DataFrame) -> DataFrame:
    """dir, path, base_url, pattern, targets of every tsconfig.json in files(path, content): JSON with comments and
    trailing commas.  A row for each pattern, and one without a pattern for each file; patterns with targets that
    are no texts are left out, as are files that are no such JSON."""
    bare = F.regexp_replace(F.regexp_replace("content", COMMENT, "$1"), COMMA, "$1")
    c = files.filter(F.col("path").rlike(r"(\A|/)tsconfig\.json\z")).select("path", F.get_json_object(bare, "$.compilerOptions").alias("o")).filter(F.col("o").startswith("{"))
    here = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("")
    base = F.coalesce(X.resolve_dots(F.concat(here, F.lit("/"), F.coalesce(F.get_json_object("o", "$.baseUrl"), F.lit(".")))), here)
    c = c.select("path", here.alias("dir"), base.alias("base_url"), F.get_json_object("o", "$.paths").alias("paths"))
    raw = F.from_json("paths", "map<string,string>")
    pairs = c.select("path", "dir", "base_url", F.explode(raw).alias("pattern", "json")).filter(F.col("json").rlike(r'\A\[\s*("(?:\\.|[^"\\])*"\s*(,\s*"(?:\\.|[^"\\])*"\s*)*)?\]\z'))
    pairs = pairs.select("path", "dir", "base_url", "pattern", F.from_json("json", "array<string>").alias("targets"))
    none = c.select("path", "dir", "base_url", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("array<string>").alias("targets"))
    return pairs.unionByName(none)


def workspace_packages(files: DataFrame) -> DataFrame:
    """name, root, subpath, targets of every package.json with a name: what it exports, whatever the conditions; for
    `.` else types, module, main or index.  Targets are sorted, each once, without a leading ./."""
    m = files.filter(F.col("path").rlike(r"(\A|/)package\.json\z") & F.col("content").rlike(r"\A\s*\{"))
    at = lambda k: F.get_json_object("content", f"$.{k}")
    root = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("")
    m = m.select(at("name").alias("name"), root.alias("root"), at("exports").alias("exports"), F.coalesce(at("types"), at("module"), at("main"), F.lit("index")).alias("main")).filter("name IS NOT NULL")
    keys = F.when(F.col("exports").startswith("{"), F.json_object_keys("exports"))
    subpaths = F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.startswith("."))
    whole = F.col("exports").isNotNull() & (F.size(subpaths) == 0)

    def texts(json: Column) -> Column:
        leaves = F.filter(F.regexp_extract_all(json, F.lit(TEXT), F.lit(0)), lambda t: ~t.endswith(":"))
        return F.when(json.rlike(r"\A[\[{]"), F.transform(leaves, lambda t: F.regexp_replace(t, r'\A"|"\z', ""))).otherwise(F.array(json))

    listed = m.select("name", "root", F.explode(subpaths).alias("subpath"), "exports").select("name", "root", "subpath", texts(F.expr("get_json_object(exports, concat('$[\\'', subpath, '\\']'))")).alias("targets"))
    one = m.filter(whole).select("name", "root", F.lit(".").alias("subpath"), texts(F.col("exports")).alias("targets"))
    rest = m.filter(~whole & ~F.array_contains(subpaths, ".")).select("name", "root", F.lit(".").alias("subpath"), texts(F.col("main")).alias("targets"))
    clean = F.array_sort(F.array_distinct(F.transform("targets", lambda t: F.regexp_replace(t, r"\A\./", ""))))
    return listed.unionByName(one).unionByName(rest).withColumn("targets", clean)


def resolve_modules(specifiers: DataFrame, paths: DataFrame, configs: DataFrame, packages: DataFrame) -> DataFrame:
    """importer, specifier, resolution, candidates, package for specifiers(importer, specifier).

    Paths that begin with a dot or slash are probed as they stand; names of workspace packages by what those
    export; others by the best pattern of the nearest configuration, then under its base; the rest is external.
    Each way is an equality join, and all their bases are probed together."""
    s = specifiers.select("importer", "specifier").distinct()
    spec, importer = F.col("specifier"), F.col("importer")
    relative = spec.startswith(".") | spec.startswith("/")
    here = F.when(importer.contains("/"), F.regexp_replace(importer, r"/[^/]*\z", "")).otherwise("")
    s = s.withColumn("dir", here).withColumn("package", F.when(~relative, X.package_name(spec)))
    known = packages.select(F.col("name").alias("package"), F.lit(True).alias("is_own")).distinct()
    s = s.join(known, "package", "left")
    local = s.filter(F.col("package").isNull()).withColumn("base", F.when(spec.startswith("/"), F.substring(spec, 2, 1 << 20)).otherwise(F.concat("dir", F.lit("/"), spec)))
    own = s.filter("is_own").withColumn("rest", F.expr("substring(specifier, length(package) + 1)"))
    own = own.withColumn("subpath", F.when(F.col("rest") == "", ".").otherwise(F.concat(F.lit("."), "rest")))
    exported = packages.select(F.col("name").alias("package"), "subpath", F.explode(F.transform("targets", lambda t: F.concat("root", F.lit("/"), t))).alias("base"))
    own = own.join(exported, ["package", "subpath"], "left")
    other = s.filter("package IS NOT NULL AND is_own IS NULL")
    above = other.select("importer", "dir").distinct().select("importer", F.explode(directories(F.concat("dir", F.lit("/x")))).alias("dir"))
    near = above.join(configs.select("dir", "path").distinct(), "dir").groupBy("importer").agg(F.max_by(F.struct("dir", "path"), F.struct(F.size(F.split("dir", "/")), F.length("dir"))).alias("c")).select("importer", F.col("c.path").alias("path"))
    other = other.join(near, "importer", "left")
    pairs = other.join(configs.filter("pattern IS NOT NULL AND length(pattern) - length(replace(pattern, '*', '')) <= 1"), "path")
    star = F.instr("pattern", "*")
    prefix, suffix = F.substring_index("pattern", "*", 1), F.when(star > 0, F.substring_index("pattern", "*", -1)).otherwise("")
    fits = F.when(star == 0, F.col("pattern") == spec).otherwise(spec.startswith(prefix) & spec.endswith(suffix) & (F.length(spec) >= F.length(prefix) + F.length(suffix)))
    literal = F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    capture = F.when(star > 0, F.substring(spec, F.length(prefix) + 1, F.length(spec) - F.length(prefix) - F.length(suffix))).otherwise("")
    best = pairs.filter(fits).withColumn("capture", capture).groupBy("importer", "specifier").agg(F.min_by(F.struct("targets", "capture", "base_url"), F.struct(-literal, "pattern")).alias("b"))
    alias = best.select("importer", "specifier", F.explode_outer(F.transform("b.targets", lambda t: F.concat("b.base_url", F.lit("/"), F.replace(t, F.lit("*"), F.col("b.capture"))))).alias("base"))
    plain = other.join(best.select("importer", "specifier"), ["importer", "specifier"], "left_anti").join(configs.filter("pattern IS NULL AND base_url <> ''").select("path", "base_url"), "path").withColumn("base", F.concat("base_url", F.lit("/"), spec))
    ways = [local.select("importer", "specifier", F.lit("path").alias("way"), "base"), own.select("importer", "specifier", F.lit("workspace").alias("way"), "base"), alias.select("importer", "specifier", F.lit("alias").alias("way"), "base"), plain.select("importer", "specifier", F.lit("base").alias("way"), "base")]
    tries = ways[0]
    for w in ways[1:]:
        tries = tries.unionByName(w)
    tries = tries.withColumn("base", X.resolve_dots(F.replace("base", F.lit("\\"), F.lit("/"))))
    hit = probe(tries.filter("base <> ''").select("base"), paths).select("base", F.explode("candidates").alias("path"))
    found = tries.join(hit, "base", "left").groupBy("importer", "specifier", "way").agg(F.sort_array(F.collect_set("path")).alias("candidates"))
    n = F.size("candidates")
    found = found.filter((F.col("way") != "base") | (n == 1)).withColumn("resolution", status(n))
    out = s.join(found, ["importer", "specifier"], "left")
    package = F.when(F.col("way").isNull() | ((F.col("way") == "workspace") & (F.col("resolution") == "unresolved")), F.col("package"))
    return out.select("importer", "specifier", F.coalesce("resolution", F.lit("external")).alias("resolution"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), package.alias("package"))


def script_language(path: Column) -> Column:
    """Language of a module by its ending."""
    return F.when(path.rlike(r"(?i)\.(?:js|jsx|mjs|cjs)\z"), "JavaScript").otherwise("TypeScript")


def script_kind(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)\.tsx\z"), "TSX").when(path.rlike(r"(?i)\.jsx\z"), "JSX").when(path.rlike(r"(?i)\.(?:js|mjs|cjs)\z"), "JS").otherwise("TS")


def resolve_names(uses: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses(path, name) to the symbol that each name stands for: id, or null.

    A symbol of the file itself shadows an imported one; imports(path, name, target, imported) lead to the first
    symbol(path, name, id, place) of that name in the target.  First matches are partial aggregates."""
    first = symbols.groupBy("path", "name").agg(F.min_by("id", "place").alias("id"))
    own = first.withColumnRenamed("id", "own")
    far = imports.join(first.select(F.col("path").alias("target"), F.col("name").alias("imported"), "id"), ["target", "imported"])
    far = far.groupBy("path", "name").agg(F.min_by("id", F.struct("target", "imported")).alias("far"))
    return uses.join(own, ["path", "name"], "left").join(far, ["path", "name"], "left").select("path", "name", F.coalesce("own", "far").alias("id"))


def resolve_members(uses: DataFrame, namespaces: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses(path, qualifier, name) of names behind a namespace, as in `api.load`, to symbols: path, qualifier, name, id.

    namespaces(path, name, target) are the imports that give a file a namespace of everything in another; of several
    of one name the last target counts.  The member is the target's first symbol(path, name, id, place, parent) of that
    name that isn't part of another; null where there is none, or no such namespace."""
    first = symbols.filter("parent IS NULL").groupBy("path", "name").agg(F.min_by("id", "place").alias("id"))
    at = namespaces.groupBy("path", F.col("name").alias("qualifier")).agg(F.max("target").alias("target"))
    members = uses.join(at, ["path", "qualifier"], "left").join(first.withColumnRenamed("path", "target"), ["target", "name"], "left")
    return members.select("path", "qualifier", "name", "id")


def dispatch(files: DataFrame, parsers: dict[str, str]) -> str:
    """Id of the one parser, of id to the pattern of paths it reads, that reads any of files(path); the only one even
    if it reads none.  None or several are errors."""
    hits = files.agg(*[F.bool_or(F.col("path").rlike(p)).alias(k) for k, p in parsers.items()]).first()
    found = sorted(k for k in parsers if hits[k])
    if not found and len(parsers) == 1:
        return next(iter(parsers))
    if not found:
        raise ValueError("no parser supports the files")
    if len(found) > 1:
        raise ValueError("several parsers support the files: " + ", ".join(found))
    return found[0]


def alias_match(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best alias for each specifier: aliases(prefix, suffix) by most literal characters, then prefix.

    Prefixes meet specifiers by equality on each of the lengths that prefixes have, not by trying
    all pairs."""
    lengths = aliases.select(F.length("prefix").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("ns"))
    tries = specifiers.crossJoin(F.broadcast(lengths)).select("specifier", F.explode("ns").alias("n"))  # one row
    tries = tries.filter(F.length("specifier") >= F.col("n")).withColumn("prefix", F.expr("substring(specifier, 1, n)"))
    hit = tries.join(aliases, "prefix").filter(F.col("specifier").endswith(F.col("suffix")) & (F.length("specifier") >= F.length("prefix") + F.length("suffix")))
    best = hit.groupBy("specifier").agg(F.max_by(F.struct("prefix", "suffix"), F.struct(F.length("prefix") + F.length("suffix"), "prefix", "suffix")).alias("b"))
    return best.select("specifier", "b.prefix", "b.suffix")


def directories(path) -> "F.Column":
    """All directories above a path, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """For each file the configuration in the deepest directory above it: an equality join on the
    directories above, then the longest.  configs(dir)."""
    above = files.select("path", F.explode(directories(F.col("path"))).alias("dir"))
    return above.join(configs.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.struct(F.length("dir"), "dir")).alias("dir"))


def path_neighbors(files: DataFrame, path: str, k: int = 20) -> DataFrame:
    """Files in the same first directory or with the same stem as one path."""
    here = F.lit(path)
    same = (X.first_segment(F.col("path")) == X.first_segment(here)) | (X.stem(F.col("path")) == X.stem(here))
    return files.filter(same & (F.col("path") != path)).select("path").distinct().orderBy("path").limit(k)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: one partial aggregate, no sort of a key's history."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
