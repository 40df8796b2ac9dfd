"""Queries of what repositories' paths say, over files of every brand's repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import repository as O
from graphloom.plans.registry import query
from graphloom.sources.records import FILES

#: The rules' patterns as the checks state them.
HITS = {
    "source": "lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('ts','tsx','js','jsx','py','go','java','rb','php','rs','c','cpp','cs','swift','kt','vue','svelte')",
    "test": "regexp_matches(path, '(?i)(test|spec|__tests__)')",
    "config": "regexp_matches(path, '(?i)(package\\.json|tsconfig|vite\\.config|next\\.config|dockerfile|compose|\\.ya?ml$|\\.toml$|\\.env)')",
    "docs": "regexp_matches(path, '(?i)(readme|contributing|architecture|docs/|security\\.md)')",
    "workflow": "regexp_matches(path, '(?i)\\.github/workflows|\\.gitlab-ci|bitbucket-pipelines')",
    "lock": "regexp_matches(path, '(?i)(package-lock|pnpm-lock|yarn\\.lock|poetry\\.lock|go\\.sum|cargo\\.lock)')",
    "security": "regexp_matches(path, '(?i)security\\.md$')",
    "env": "regexp_matches(path, '(?i)(^|/)\\.env$')",
}
CLASS = f"CASE WHEN {HITS['test']} THEN 'Test' WHEN {HITS['config']} THEN 'Configuration' WHEN {HITS['docs']} THEN 'Documentation' WHEN {HITS['source']} THEN 'Source' ELSE 'Asset' END"
MODEL = f"""f AS ({FILES.sql}),
c AS (SELECT repo, count(*) AS files, {", ".join(f"count(*) FILTER ({HITS[k]}) AS {k}s" for k in ("source", "test", "config", "docs", "workflow", "lock", "security"))}, arg_min(path, pos) FILTER ({HITS['env']}) AS env FROM f GROUP BY repo),
d AS (SELECT repo, split_part(path, '/', 1) AS dir, count(*) AS n, min(pos) AS pos FROM f GROUP BY 1, 2),
b AS (SELECT repo, dir AS top_dir, n AS top_files FROM d QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, pos) = 1),
m AS (SELECT * FROM c JOIN b USING (repo))"""


def models(spark, d):
    return O.model(FILES.read(spark, d))


@query("file_classification", f"SELECT repo, pos, path, {CLASS} AS class FROM ({FILES.sql})")
def file_classification(spark, d):
    return FILES.read(spark, d).select("repo", "pos", "path", O.classification(F.col("path")).alias("class"))


@query("path_categories", " UNION ALL ".join(f"SELECT repo, '{k}' AS category, count(*) AS files, sum(size)::BIGINT AS bytes FROM ({FILES.sql}) WHERE {hit} GROUP BY repo" for k, hit in HITS.items()))
def path_categories(spark, d):
    f = FILES.read(spark, d)
    return f.select("repo", "size", F.explode(O.categories(F.col("path"))).alias("category")).groupBy("repo", "category").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("biggest_directory", f"WITH {MODEL} SELECT repo, top_dir, top_files FROM m")
def biggest_directory(spark, d):
    return models(spark, d).select("repo", "top_dir", "top_files")


@query("path_security", f"""WITH {MODEL}, x AS (SELECT repo, 1 AS o, 'High' AS level, 'Environment file is indexed' AS title, env AS file FROM m WHERE env IS NOT NULL
UNION ALL SELECT repo, 2, 'Medium', 'No SECURITY.md found', NULL FROM m WHERE securitys = 0 UNION ALL SELECT repo, 3, 'Medium', 'No dependency lockfile detected', NULL FROM m WHERE locks = 0
UNION ALL SELECT repo, 4, 'Low', 'No CI workflow detected', NULL FROM m WHERE workflows = 0),
y AS (SELECT * FROM x UNION ALL SELECT repo, 5, 'Info', 'No path-level security warnings', NULL FROM m WHERE repo NOT IN (SELECT repo FROM x))
SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY o) - 1)::INTEGER AS place, level, title, file FROM y""")
def path_security(spark, d):
    return O.path_security(models(spark, d))


@query("finding_total", f"""WITH {MODEL} SELECT repo, (env IS NOT NULL)::BIGINT + (securitys = 0)::BIGINT + (locks = 0)::BIGINT + (workflows = 0)::BIGINT AS findings FROM m""")
def finding_total(spark, d):
    """Findings that are more than information."""
    return O.path_security(models(spark, d)).groupBy("repo").agg(F.count_if(F.col("level") != "Info").alias("findings"))


@query("path_risks", f"""WITH {MODEL}, x AS (SELECT repo, 1 AS o, 'Repository concentration' AS title, top_dir || ' contains ' || top_files || ' of ' || files || ' indexed paths.' AS detail, 72 AS score FROM m WHERE top_files > 20 AND top_files > 0.55 * files
UNION ALL SELECT repo, 2, 'No tests detected', 'No test/spec paths were identified in the indexed tree.', 81 FROM m WHERE tests = 0
UNION ALL SELECT repo, 3, 'Low test proximity', sources || ' source files map to only ' || tests || ' test files.', 68 FROM m WHERE sources > 200 AND 20 * tests < sources),
y AS (SELECT * FROM x UNION ALL SELECT repo, 4, 'No structural hotspot detected', 'The repository tree is reasonably distributed. Symbol-level analysis may reveal deeper coupling.', 22 FROM m WHERE repo NOT IN (SELECT repo FROM x))
SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY o) - 1)::INTEGER AS place, title, detail, score::INTEGER AS score, CASE WHEN score > 70 THEN 'High' WHEN score > 45 THEN 'Medium' ELSE 'Low' END AS label FROM y""")
def path_risks(spark, d):
    return O.structural_risks(models(spark, d))


@query("recommendations", f"""WITH {MODEL}, x AS (SELECT repo, 1 AS o, 'P0' AS priority, 'Add a baseline test suite' AS title, 'No test files were found in this repository.' AS reason FROM m WHERE tests = 0
UNION ALL SELECT repo, 2, 'P1', 'Add continuous integration', 'No provider workflow was found.' FROM m WHERE workflows = 0
UNION ALL SELECT repo, 3, 'P1', 'Create a security policy', 'Contributors need a private vulnerability-reporting path.' FROM m WHERE securitys = 0
UNION ALL SELECT repo, 4, 'P0', 'Remove committed environment secrets', env || ' should not be versioned.' FROM m WHERE env IS NOT NULL
UNION ALL SELECT repo, 5, 'P2', 'Document the project architecture', CASE WHEN docss > 0 THEN 'Build on the ' || docss || ' existing documentation files.' ELSE 'No architecture documentation was detected.' END FROM m)
SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY o) - 1)::INTEGER AS place, priority, title, reason FROM x""")
def recommendations(spark, d):
    return O.recommendations(models(spark, d))


@query("onboarding_path", f"""WITH f AS ({FILES.sql}), r AS (SELECT DISTINCT repo FROM f), h AS (
SELECT repo, 1 AS step, pos, path FROM f WHERE {HITS['docs']} AND contains(lower(path), 'readme')
UNION ALL SELECT repo, 2, pos + CASE WHEN regexp_matches(path, '(?i)(^|/)(index|main|app|server)\\.(ts|tsx|js|jsx|py|go|rs|java)$') THEN 0 ELSE 1000000000000 END, path FROM f WHERE {HITS['source']}
UNION ALL SELECT repo, 3, pos, path FROM f WHERE {HITS['config']} UNION ALL SELECT repo, 4, pos, path FROM f WHERE {HITS['test']} UNION ALL SELECT repo, 5, pos, path FROM f WHERE {HITS['workflow']}),
g AS (SELECT repo, step, arg_min(path, pos) AS path FROM h GROUP BY 1, 2)
SELECT r.repo, s.step::INTEGER AS step, path FROM r CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) AS s LEFT JOIN g ON g.repo = r.repo AND g.step = s.step""")
def onboarding_path(spark, d):
    return O.onboarding(FILES.read(spark, d))


@query("matching_tests", f"""WITH f AS (SELECT DISTINCT repo, path FROM ({FILES.sql})), t AS (SELECT repo, path AS target, split_part(split_part(path, '/', -1), '.', 1) AS stem FROM f)
SELECT t.repo, target, path AS test FROM t JOIN f ON f.repo = t.repo AND stem <> '' AND contains(path, stem) WHERE {HITS['test']}""")
def matching_tests(spark, d):
    f = FILES.read(spark, d)
    return O.matching_tests(f.select("repo", "path").distinct(), f)


_SEGMENTS = "len(list_intersect(string_split(path, '/'), ['node_modules', '.git', '.next', 'dist', 'build', 'coverage', '.turbo', '.cache', 'vendor', 'target', 'out'])) = 0"


@query("local_import", f"""WITH f AS (SELECT *, {_SEGMENTS} AS accepted FROM ({FILES.sql})),
g AS (SELECT *, accepted AND size <= 120000 AND ({HITS['source']} OR regexp_matches(path, '(?i)[.](json|md|ya?ml|toml|sql|graphql|css|html)$')) AS fits FROM f)
SELECT repo, pos, path, accepted, fits AND count(*) FILTER (fits) OVER (PARTITION BY repo ORDER BY pos ROWS UNBOUNDED PRECEDING) <= 200 AS readable FROM g""")
def local_import(spark, d):
    return O.local_import(FILES.read(spark, d)).select("repo", "pos", "path", "accepted", "readable")


@query("language_histogram", f"SELECT repo, CASE WHEN contains(split_part(path, '/', -1), '.') THEN lower(split_part(path, '.', -1)) ELSE 'none' END AS language, count(*) AS files FROM ({FILES.sql}) WHERE {_SEGMENTS} GROUP BY ALL")
def language_histogram(spark, d):
    return O.languages(FILES.read(spark, d))


@query("tree_search", f"""WITH p AS (SELECT DISTINCT repo, path, string_split(path, '/') AS s FROM ({FILES.sql})), x AS (SELECT repo, s, unnest(range(1, len(s) + 1)) AS i FROM p),
t AS (SELECT DISTINCT repo, array_to_string(s[1:i], '/') AS path, CASE WHEN i = len(s) THEN 'file' ELSE 'folder' END AS kind FROM x)
SELECT repo, path, kind FROM t WHERE contains(lower(path), 'index') OR (kind = 'folder' AND EXISTS (SELECT 1 FROM t AS c WHERE c.repo = t.repo AND contains(lower(c.path), 'index') AND starts_with(c.path, t.path || '/') AND NOT contains(c.path[length(t.path) + 2:], '/')))""")
def tree_search(spark, d):
    return O.search_paths(FILES.read(spark, d), "Index")
