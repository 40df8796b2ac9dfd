"""What the paths of repositories say: categories, security, risks, recommendations and where to start.

All reports take files(repo, pos, path, ...) of any number of repositories and aggregate by repo; pos is a
file's place in its list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X

#: Endings of source files.
CODE = ("ts", "tsx", "js", "jsx", "py", "go", "java", "rb", "php", "rs", "c", "cpp", "cs", "swift", "kt", "vue", "svelte")
#: Patterns of paths by category.
TEST = r"(?i)(test|spec|__tests__)"
CONFIG = r"(?i)(package\.json|tsconfig|vite\.config|next\.config|dockerfile|compose|\.ya?ml\z|\.toml\z|\.env)"
DOCS = r"(?i)(readme|contributing|architecture|docs/|security\.md)"
WORKFLOW = r"(?i)\.github/workflows|\.gitlab-ci|bitbucket-pipelines"
LOCK = r"(?i)(package-lock|pnpm-lock|yarn\.lock|poetry\.lock|go\.sum|cargo\.lock)"
SECURITY = r"(?i)security\.md\z"
ENV = r"(?i)(\A|/)\.env\z"
README = r"(?i)readme"
ENTRY = r"(?i)(\A|/)(index|main|app|server)\.(ts|tsx|js|jsx|py|go|rs|java)\z"
#: Directories that local imports leave out, and endings of text files they read besides source.
IGNORED = ("node_modules", ".git", ".next", "dist", "build", "coverage", ".turbo", ".cache", "vendor", "target", "out")
READABLE = r"(?i)[.](json|md|ya?ml|toml|sql|graphql|css|html)\z"
#: Bytes and number of files that a local import reads at most.
LOCAL_BYTES, LOCAL_FILES = 120_000, 200


def is_source(path: Column) -> Column:
    return X.extension(path).isin(*CODE)


def classification(path: Column) -> Column:
    """The one class of a file: Test, Configuration, Documentation, Source or Asset."""
    return F.when(path.rlike(TEST), "Test").when(path.rlike(CONFIG), "Configuration").when(path.rlike(DOCS), "Documentation").when(is_source(path), "Source").otherwise("Asset")


def categories(path: Column) -> Column:
    """All lists of a repository's model that a file is in; a file may be in several or none."""
    marks = (("source", is_source(path)), ("test", path.rlike(TEST)), ("config", path.rlike(CONFIG)), ("docs", path.rlike(DOCS)), ("workflow", path.rlike(WORKFLOW)), ("lock", path.rlike(LOCK)), ("security", path.rlike(SECURITY)), ("env", path.rlike(ENV)))
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in marks]))


def model(files: DataFrame) -> DataFrame:
    """One row per repository: counts of the lists, the first environment file, and the largest first
    segment with its count (of several, that which comes first)."""
    p = F.col("path")
    per = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(is_source(p)).alias("sources"),
        F.count_if(p.rlike(TEST)).alias("tests"),
        F.count_if(p.rlike(CONFIG)).alias("configs"),
        F.count_if(p.rlike(DOCS)).alias("docs"),
        F.count_if(p.rlike(WORKFLOW)).alias("workflows"),
        F.bool_or(p.rlike(LOCK)).alias("has_lock"),
        F.bool_or(p.rlike(SECURITY)).alias("has_security"),
        F.min_by(F.when(p.rlike(ENV), p), F.when(p.rlike(ENV), F.col("pos"))).alias("env"),
    )
    tops = files.groupBy("repo", X.first_segment(p).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    big = tops.groupBy("repo").agg(F.max_by(F.struct("dir", "n"), F.struct("n", -F.col("pos"))).alias("top"))
    return per.join(big, "repo").select(*per.columns, F.col("top.dir").alias("top_dir"), F.col("top.n").alias("top_files"))


def _rows(models: DataFrame, items: list[tuple[Column, dict[str, Column]]], otherwise: dict[str, Column] | None = None) -> DataFrame:
    """repo, place and the fields of each item whose condition holds, in order; `otherwise` where none does."""
    made = F.array_compact(F.array(*[F.when(hit, F.struct(*[v.alias(k) for k, v in fields.items()])) for hit, fields in items]))
    if otherwise:
        made = F.when(F.size(made) == 0, F.array(F.struct(*[v.alias(k) for k, v in otherwise.items()]))).otherwise(made)
    return models.select("repo", F.posexplode(made).alias("place", "item")).select("repo", "place", "item.*")


def path_security(models: DataFrame) -> DataFrame:
    """Findings that paths alone give, or one that says there are none."""
    none = F.lit(None).cast("string")
    row = lambda level, title, file=none: {"level": F.lit(level), "title": F.lit(title), "file": file}
    return _rows(
        models,
        [
            (F.col("env").isNotNull(), row("High", "Environment file is indexed", F.col("env"))),
            (~F.col("has_security"), row("Medium", "No SECURITY.md found")),
            (~F.col("has_lock"), row("Medium", "No dependency lockfile detected")),
            (F.col("workflows") == 0, row("Low", "No CI workflow detected")),
        ],
        row("Info", "No path-level security warnings"),
    )


def structural_risks(models: DataFrame) -> DataFrame:
    """Risks of a repository's shape with score and label; a repository may have several."""
    n = F.col("files").cast("string")
    row = lambda title, detail, score: {"title": F.lit(title), "detail": detail, "score": F.lit(score)}
    out = _rows(
        models,
        [
            (F.col("top_files") > F.greatest(F.lit(20.0), F.col("files") * 0.55), row("Repository concentration", F.concat("top_dir", F.lit(" contains "), F.col("top_files").cast("string"), F.lit(" of "), n, F.lit(" indexed paths.")), 72)),
            (F.col("tests") == 0, row("No tests detected", F.lit("No test/spec paths were identified in the indexed tree."), 81)),
            ((F.col("sources") > 200) & (F.col("tests") < F.col("sources") * 0.05), row("Low test proximity", F.concat(F.col("sources").cast("string"), F.lit(" source files map to only "), F.col("tests").cast("string"), F.lit(" test files.")), 68)),
        ],
        row("No structural hotspot detected", F.lit("The repository tree is reasonably distributed. Symbol-level analysis may reveal deeper coupling."), 22),
    )
    return out.withColumn("label", risk_label(F.col("score")))


def risk_label(score: Column) -> Column:
    return F.when(score > 70, "High").when(score > 45, "Medium").otherwise("Low")


def recommendations(models: DataFrame) -> DataFrame:
    """What to do next, by priority as listed; documentation always comes last."""
    row = lambda p, title, reason: {"priority": F.lit(p), "title": F.lit(title), "reason": reason}
    docs = F.when(F.col("docs") > 0, F.concat(F.lit("Build on the "), F.col("docs").cast("string"), F.lit(" existing documentation files."))).otherwise("No architecture documentation was detected.")
    return _rows(
        models,
        [
            (F.col("tests") == 0, row("P0", "Add a baseline test suite", F.lit("No test files were found in this repository."))),
            (F.col("workflows") == 0, row("P1", "Add continuous integration", F.lit("No provider workflow was found."))),
            (~F.col("has_security"), row("P1", "Create a security policy", F.lit("Contributors need a private vulnerability-reporting path."))),
            (F.col("env").isNotNull(), row("P0", "Remove committed environment secrets", F.concat("env", F.lit(" should not be versioned.")))),
            (F.lit(True), row("P2", "Document the project architecture", docs)),
        ],
    )


def onboarding(files: DataFrame) -> DataFrame:
    """Five steps of each repository with the first file in list order that serves, null where none does."""
    p, pos = F.col("path"), F.col("pos")
    first = lambda hit: F.min_by(F.when(hit, p), F.when(hit, pos))
    source = is_source(p)
    steps = [first(p.rlike(DOCS) & p.rlike(README)), F.coalesce(first(source & p.rlike(ENTRY)), first(source)), first(p.rlike(CONFIG)), first(p.rlike(TEST)), first(p.rlike(WORKFLOW))]
    per = files.groupBy("repo").agg(*[s.alias(f"s{i}") for i, s in enumerate(steps, 1)])
    return per.select("repo", F.posexplode(F.array(*[f"s{i}" for i in range(1, 6)])).alias("n", "path")).select("repo", (F.col("n") + 1).alias("step"), "path")


def matching_tests(targets: DataFrame, files: DataFrame) -> DataFrame:
    """repo, target, test: test files whose path holds the target's stem, an empty stem matching none.

    Stems and paths meet by the parts that paths have: every substring of a test path as long as
    some stem of the repository, so that an equality join does it instead of all pairs."""
    t = targets.select("repo", F.col("path").alias("target"), X.stem(F.col("path")).alias("stem")).filter("stem <> ''")
    lengths = t.groupBy("repo").agg(F.collect_set(F.length("stem")).alias("lengths"))  # a few tens
    tests = files.filter(F.col("path").rlike(TEST)).select("repo", F.col("path").alias("test")).distinct().join(lengths, "repo")
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("test")), lambda n: F.transform(F.sequence(F.lit(1), F.length("test") - n + 1), lambda i: F.substring("test", i, n)))
    parts = tests.select("repo", "test", F.explode(F.array_distinct(F.flatten(starts))).alias("stem"))
    return t.join(parts, ["repo", "stem"]).select("repo", "target", "test").distinct()


def local_import(files: DataFrame) -> DataFrame:
    """files(repo, pos, path, size) with accepted (no ignored segment) and readable (accepted, small, of a
    known ending, and among the first LOCAL_FILES such of its repository)."""
    p = F.col("path")
    accepted = ~F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in IGNORED]))
    fits = accepted & (F.col("size") <= LOCAL_BYTES) & (is_source(p) | p.rlike(READABLE))
    before = F.sum(fits.cast("int")).over(Window.partitionBy("repo").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("accepted", accepted).withColumn("readable", fits & (before <= LOCAL_FILES))


def languages(files: DataFrame) -> DataFrame:
    """Files of each extension, of those that a local import accepts."""
    return local_import(files).filter("accepted").groupBy("repo", X.extension(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def search_paths(files: DataFrame, text: str) -> DataFrame:
    """Files and folders of a tree that a search shows: those whose path holds the text, whatever its case, and
    folders of which a direct child does.  Columns repo, path, kind."""
    needle = text.lower()
    p = files.select("repo", "path").distinct()
    levels = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    tree = p.select("repo", F.posexplode(levels).alias("i", "at"), F.size(F.split("path", "/")).alias("n"))
    tree = tree.select("repo", F.col("at").alias("path"), F.when(F.col("i") + 1 == F.col("n"), "file").otherwise("folder").alias("kind")).distinct()
    hit = F.lower("path").contains(needle)
    parents = tree.filter(hit & F.col("path").contains("/")).select("repo", F.regexp_replace("path", r"/[^/]*\z", "").alias("path"), F.lit("folder").alias("kind"))
    return tree.filter(hit).unionByName(tree.join(parents.distinct(), ["repo", "path", "kind"], "left_semi")).distinct()


def analyzed_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """repo, path, pos of the files(repo, path, pos) that entries(repo, path) list; of several with one path the last."""
    last = files.groupBy("repo", "path").agg(F.max("pos").alias("pos"))
    return last.join(entries.select("repo", "path").distinct(), ["repo", "path"])
