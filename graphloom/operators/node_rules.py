"""Rules of graph nodes that come as JSON: kind, metadata of each kind, and location, against a snapshot's manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions import text as X
from graphloom.operators import contracts as C
from graphloom.operators import requests as R

#: Metadata that each kind must have and may have, and who may see a symbol.
METADATA = {
    "file": (("path",), ("language", "sizeBytes", "contentSha256", "module")),
    "symbol": (("symbolKind",), ("qualifiedName", "signature", "visibility", "exported", "async")),
    "package": (("packageName",), ("version", "manager", "workspacePath")),
    "route": (("path", "methods"), ("framework",)),
    "schema": (("schemaKind",), ("qualifiedName", "fields")),
}
VISIBILITIES = ("public", "protected", "private", "internal")
#: Metadata that is plain text, whatever the kind.
TEXTS = ("language", "module", "symbolKind", "qualifiedName", "signature", "packageName", "version", "manager", "framework", "schemaKind")
PLACES = ("startLine", "startColumn", "endLine", "endColumn")


def strict(t: Column) -> Column:
    return R.trimmed(t) & ~t.rlike(r"[\x00-\x1F\x7F]")


def _safe(path: Column) -> Column:
    return F.coalesce(strict(path) & X.safe_path(path), F.lit(False))


def node_violations(nodes: DataFrame, manifest: DataFrame, key: str, body: str) -> DataFrame:
    """key, rule of every rule that a node breaks.  manifest(path): the snapshot's files, which a file's and a location's
    path must be among.  Text that isn't a JSON object breaks `object`; a node of no known kind has no rules of metadata."""
    v, m, at = F.col("__value"), F.col("__meta"), F.col("__at")
    rows = nodes.withColumn("__value", R.parsed(F.col(body)))
    rows = rows.withColumns({"__meta": R.field(v, "metadata"), "__at": R.field(v, "location"), "__kind": R.text_at(v, "kind")})
    rows = rows.withColumns({"__path": R.text_at(m, "path"), "__place": R.text_at(at, "path")})
    known = manifest.select("path").distinct()
    rows = rows.join(known.select(F.col("path").alias("__path"), F.lit(True).alias("__listed")), "__path", "left")
    rows = rows.join(known.select(F.col("path").alias("__place"), F.lit(True).alias("__placed")), "__place", "left")
    kind, own, mine, place = F.col("__kind"), R.keys(v), R.keys(m), R.keys(at)
    pairs = lambda pick: F.try_element_at(F.create_map(*[x for k, ks in METADATA.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in pick(*ks)]))]), kind)
    may = pairs(lambda needs, opt: (*needs, *opt))
    has = lambda k: F.array_contains(mine, k) & F.array_contains(may, k)
    at_has = lambda k: F.array_contains(place, k)
    text = lambda of, k: ~F.coalesce(strict(R.text_at(of, k)), F.lit(False))
    lists = lambda k: ~F.coalesce(F.forall(R.texts_at(m, k), lambda x: R.trimmed(F.trim(x))), F.lit(False))
    either = lambda *tests: F.greatest(*[F.coalesce(t, F.lit(False)) for t in tests]) if len(tests) > 1 else tests[0]
    n = {k: R.whole_number_at(at, k) for k in PLACES}
    fails = {
        "object": own.isNull(),
        "unknown-key": F.size(F.array_except(own, F.array(*[F.lit(k) for k in ("id", "kind", "name", "metadata", "location")]))) > 0,
        "missing-key": F.size(F.array_except(F.array(*[F.lit(k) for k in ("id", "kind", "name", "metadata")]), own)) > 0,
        "kind": own.isNotNull() & ~F.coalesce(kind.isin(*S.NODE_KINDS), F.lit(False)),
        "id": F.array_contains(own, "id") & text(v, "id"),
        "name": F.array_contains(own, "name") & text(v, "name"),
        "metadata": F.array_contains(own, "metadata") & mine.isNull(),
        "metadata-unknown-key": F.size(F.array_except(mine, may)) > 0,
        "metadata-missing-key": F.size(F.array_except(pairs(lambda needs, _: needs), mine)) > 0,
        "metadata-text": either(*[has(k) & text(m, k) for k in TEXTS], (kind == "route") & has("path") & text(m, "path")),
        "metadata-path": either((kind == "file") & has("path") & ~_safe(F.col("__path")), has("workspacePath") & ~_safe(R.text_at(m, "workspacePath"))),
        "metadata-manifest": (kind == "file") & _safe(F.col("__path")) & F.col("__listed").isNull(),
        "size": has("sizeBytes") & ~F.coalesce(R.whole_number_at(m, "sizeBytes") >= 0, F.lit(False)),
        "sha256": has("contentSha256") & ~F.coalesce(R.text_at(m, "contentSha256").rlike(C.SHA256), F.lit(False)),
        "visibility": has("visibility") & ~F.coalesce(R.text_at(m, "visibility").isin(*VISIBILITIES), F.lit(False)),
        "flag": either(*[has(k) & ~F.coalesce(R.type_of(R.field(m, k)) == "BOOLEAN", F.lit(False)) for k in ("exported", "async")]),
        "list": either(*[has(k) & lists(k) for k in ("methods", "fields")]),
        "location": F.array_contains(own, "location") & place.isNull(),
        "location-key": either(F.size(F.array_except(place, F.array(F.lit("path"), *[F.lit(k) for k in PLACES]))) > 0, ~at_has("path")),
        "location-path": at_has("path") & ~_safe(F.col("__place")),
        "location-manifest": at_has("path") & _safe(F.col("__place")) & F.col("__placed").isNull(),
        "location-number": either(*[at_has(k) & ~F.coalesce(n[k] >= 1, F.lit(False)) for k in PLACES]),
        "location-start": either((at_has("startColumn") | at_has("endColumn") | at_has("endLine")) & ~at_has("startLine"), at_has("endColumn") & ~at_has("endLine")),
        "location-order": either(n["endLine"] < n["startLine"], (n["endLine"] == n["startLine"]) & (n["endColumn"] < F.coalesce(n["startColumn"], F.lit(1)))),
    }
    return C.broken(rows, [key], {name: F.coalesce(fail, F.lit(False)) for name, fail in fails.items()})
