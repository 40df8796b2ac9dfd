"""Requests that come as JSON: graph queries, job requests, messages and responses, read as VARIANT.

A field is asked for by its path in the parsed value, with its type, so neither a nested key of the same name nor a
number in quotes passes for it.  Every request gets the list of rules that it breaks and, if it breaks none, its
parsed form with defaults filled in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.operators import contracts as C

#: Fixed value: characters that a trimmed text neither begins nor ends with.
BLANK = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Fixed value: addresses of repositories that requests may name.
REQUEST_URL = rf"\A(?i:https):[/\\]*(?::?@)?(?i:github\.com)(?::(?:0*443)?)?[/\\]{C.SEGMENT}[/\\]{C.SEGMENT}(?:\.git)?\??#?\z"
#: Largest whole number that a request may hold.
SAFE = 2**53 - 1
DIRECTIONS = ("incoming", "outgoing", "both")


def parsed(body: Column) -> Column:
    """The value of a JSON text; null for anything else.  Keys in any order, repeated keys refused."""
    return F.when(F.rtrim(body).rlike(r"[\}\]\"0-9el]\z"), F.try_parse_json(body))


def canonical_json(body: Column) -> Column:
    """A JSON text with the keys of all objects, however deep, in order of their bytes and without blanks; null for
    text that isn't JSON.  Whole numbers lose a fraction of zero."""
    return F.to_json(parsed(body))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column whose value is worked out once a row.

    It comes out of a generator, which filters aren't moved across: they would otherwise repeat the whole expression,
    and with it the parsing, in every place that names the column."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def keys(value: Column) -> Column:
    """Names of an object's own fields; null for anything but an object."""
    return F.map_keys(value.try_cast("map<string, variant>"))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def type_of(value: Column) -> Column:
    """Type of a value, such as STRING, BIGINT, DOUBLE, DECIMAL(3,1), BOOLEAN, VOID, ARRAY<...> or OBJECT<...>."""
    return F.schema_of_variant(value)


def text_at(value: Column, name: str) -> Column:
    """A field's text; null unless it is text."""
    v = field(value, name)
    return F.when(type_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def whole_number_at(value: Column, name: str) -> Column:
    """A field's number; null unless it is a whole one that a double holds exactly."""
    v = field(value, name)
    n = F.try_variant_get(v, "$", "double")
    return F.when(type_of(v).rlike(r"\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL)") & (n == F.floor(n)) & (F.abs(n) <= SAFE), n.cast("long"))


def texts_at(value: Column, name: str) -> Column:
    """A field's list, null in place of items that aren't text; null unless it is a list."""
    items = F.try_variant_get(value, f"$.{name}", "array<variant>")
    return F.transform(items, lambda x: F.when(type_of(x) == "STRING", F.try_variant_get(x, "$", "string")))


def trimmed(text: Column) -> Column:
    """Whether text is there, not empty, and without blanks around it."""
    return F.coalesce((text != "") & ~text.rlike(rf"\A{BLANK}|{BLANK}\z"), F.lit(False))


def units(text: Column) -> Column:
    """Length in 16-bit units."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def strict(text: Column, most: int) -> Column:
    return trimmed(text) & (units(text) <= most) & ~text.rlike(r"[\x00-\x1F\x7F]")


@dataclass
class Shape:
    """An object's required and optional keys, and rules that fail on (value, has): its parsed value and a function
    that says whether it has a key."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    rules: dict | None = None


def violations(value: Column, shape: Shape) -> list[Column]:
    """Names of the rules that an object of a shape breaks, null for those it keeps."""
    own = keys(value)
    has = lambda k: F.array_contains(own, k)
    known = F.array(*[F.lit(k) for k in (*shape.required, *shape.optional)])
    fails = {"unknown-key": F.size(F.array_except(own, known)) > 0}
    fails["missing-key"] = F.size(F.array_except(F.array(*[F.lit(k) for k in shape.required]), own)) > 0
    fails |= {name: rule(value, has) for name, rule in (shape.rules or {}).items()}
    return [F.when(fail, F.lit(name)) for name, fail in fails.items()]


def _text(name: str, ok):
    return lambda v, has: has(name) & ~F.coalesce(ok(text_at(v, name)), F.lit(False))


def _number(name: str, low: int, high: int):
    return lambda v, has: has(name) & ~F.coalesce(whole_number_at(v, name).between(low, high), F.lit(False))


def _list(name: str, known):
    def rule(v, has):
        items = texts_at(v, name)
        good = (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(x.isin(*known), F.lit(False)))
        return has(name) & ~F.coalesce(good, F.lit(False))

    return rule


def _any(*rules):
    def rule(v, has):
        out = rules[0](v, has)
        for r in rules[1:]:
            out = out | r(v, has)
        return out

    return rule


_BUDGET = {"maxCost": S.MAX_COST, "maxResults": S.MAX_RESULTS, "maxTimeMs": C.MAX_TIME}
_ID = lambda t: strict(t, C.TEXT_LENGTH)
#: Rules of the fields that only some kinds of queries have.
_FIELDS = {
    "text": ("text", _text("text", lambda t: strict(t, C.SEARCH_LENGTH))),
    "nodeId": ("node-id", _text("nodeId", _ID)),
    "from": ("node-id", _text("from", _ID)),
    "to": ("node-id", _text("to", _ID)),
    "kinds": ("kinds", _list("kinds", S.ASKED_KINDS)),
    "edgeKinds": ("edge-kinds", _list("edgeKinds", S.EDGE_KINDS)),
    "direction": ("direction", _text("direction", lambda t: t.isin(*DIRECTIONS))),
    "cursor": ("cursor", _number("cursor", 0, S.MAX_COST[1])),
    "maxDepth": ("depth", _number("maxDepth", 1, S.MAX_DEPTH[1])),
}


def _by_type(type_: Column, names) -> Column:
    """Array of names that a function gives for a query's type; null for other types."""
    pairs = [x for kind, (needs, may) in C.QUERY_KEYS.items() for x in (F.lit(kind), F.array(*[F.lit(n) for n in names(needs, may)]))]
    return F.try_element_at(F.create_map(*pairs), type_)


def graph_queries(queries: DataFrame, key: str, body: str) -> DataFrame:
    """key, violations, query for every row.  violations: sorted names of the rules broken.  query: null if there are
    any, else type, text, node_id, from, to, direction, kinds and edge_kinds (sorted, each once, null where not
    given), cursor, max_depth, max_cost, max_results, max_time; fields that its type lacks are null, all others
    have their defaults.  Null bodies, text that isn't JSON and values other than objects break the rule `object`."""
    v = F.col("__value")
    # dealt by rows, as they take far more work than their bytes say
    rows = once(queries.select(key, body).repartition(key, body), "__value", parsed(F.col(body)))
    rows = once(rows, "__of", F.struct(text_at(v, "type").alias("type"), keys(v).alias("own"), field(v, "budget").alias("budget")))
    type_, own, budget = F.col("__of.type"), F.col("__of.own"), F.col("__of.budget")
    allowed, limits = _by_type(type_, lambda needs, may: ("type", "budget", *needs, *may)), keys(budget)
    rows = once(rows, "__has", F.struct(F.array_intersect(own, allowed).alias("keys"), limits.alias("limits")))
    has = lambda k: F.array_contains("__has.keys", k)
    limits = F.col("__has.limits")
    budget_has = lambda k: F.array_contains(limits, k)
    fails = {
        "object": own.isNull(),
        "type": own.isNotNull() & ~F.coalesce(type_.isin(*C.QUERY_KEYS), F.lit(False)),
        "unknown-key": F.size(F.array_except(own, allowed)) > 0,
        "missing-key": F.size(F.array_except(_by_type(type_, lambda needs, may: ("type", *needs)), own)) > 0,
        "budget-key": F.array_contains(own, "budget") & F.coalesce(F.size(F.array_except(limits, F.array(*[F.lit(k) for k in _BUDGET]))) > 0, F.lit(True)),
        "budget": _any(*[_number(k, 1, high) for k, (_, high) in _BUDGET.items()])(budget, budget_has),
    }
    tests = [(name, F.coalesce(fail, F.lit(False))) for name, fail in fails.items()]
    tests += [(name, F.coalesce(rule(v, has), F.lit(False))) for name, rule in _FIELDS.values()]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(fail, F.lit(name)) for name, fail in tests]))))
    of = lambda *kinds: type_.isin(*kinds)
    walk = of("neighbors", "impact", "shortestPath")
    limit = lambda k: F.coalesce(whole_number_at(budget, k), F.lit(_BUDGET[k][0]).cast("long"))
    listed = lambda k: F.array_sort(F.array_distinct(texts_at(v, k)))
    query = F.struct(
        type_.alias("type"),
        F.when(of("search"), text_at(v, "text")).alias("text"),
        F.when(of("node", "explain", "neighbors", "impact"), text_at(v, "nodeId")).alias("node_id"),
        F.when(of("shortestPath"), text_at(v, "from")).alias("from"),
        F.when(of("shortestPath"), text_at(v, "to")).alias("to"),
        F.when(walk, F.coalesce(text_at(v, "direction"), F.lit("both"))).alias("direction"),
        F.when(of("search"), listed("kinds")).alias("kinds"),
        F.when(walk, listed("edgeKinds")).alias("edge_kinds"),
        F.when(of("search", "neighbors"), F.coalesce(whole_number_at(v, "cursor"), F.lit(0).cast("long"))).alias("cursor"),
        F.when(of("impact", "shortestPath"), F.coalesce(whole_number_at(v, "maxDepth"), F.lit(S.MAX_DEPTH[0]).cast("long"))).alias("max_depth"),
        limit("maxCost").alias("max_cost"),
        limit("maxResults").alias("max_results"),
        limit("maxTimeMs").alias("max_time"),
    )
    rows = once(rows, "violations", found)
    return once(rows, "query", F.when(F.size("violations") == 0, query)).select(key, "violations", "query")


def query_violations(queries: DataFrame, key: str, body: str) -> DataFrame:
    """key, rule: what graph queries, as JSON, break."""
    return graph_queries(queries, key, body).select(key, F.explode("violations").alias("rule"))


#: Requests besides graph queries: of a client for a job, of the service to the store, a result that is sent back,
#: and a message of the queue.
REQUESTS = {
    "create": Shape(("repositoryUrl",), ("ref",), {"url": _text("repositoryUrl", lambda t: trimmed(t) & t.rlike(REQUEST_URL)), "ref": _text("ref", trimmed)}),
    "input": Shape(
        ("analyzerVersion", "idempotencyKey", "repositoryId", "requestedRef"),
        (),
        {
            "text": _any(*[_text(k, trimmed) for k in ("analyzerVersion", "idempotencyKey", "requestedRef")]),
            "repository-id": _text("repositoryId", lambda t: t.rlike(C.REPOSITORY_ID)),
        },
    ),
    "response": Shape(
        ("jobId", "status", "result"),
        (),
        {
            "status": _text("status", lambda t: t == "succeeded"),
            "job-id": _text("jobId", trimmed),
            "result": lambda v, has: has("result") & keys(field(v, "result")).isNull(),
        },
    ),
    "message": Shape(
        ("schemaVersion", "jobId", "expectedStage"),
        ("cursor",),
        {
            "schema": _text("schemaVersion", lambda t: t == "1.0"),
            "job-id": _text("jobId", trimmed),
            "stage": _text("expectedStage", lambda t: t.isin(*C.STAGES[:3])),
            "cursor": _text("cursor", trimmed),
        },
    ),
}


def requests(rows: DataFrame, kind: str, body: str, shown: dict[str, str]) -> DataFrame:
    """rows with violations (sorted names of the rules that a request of this kind breaks) and request: a struct of
    its texts under the names that `shown` gives their keys, null if it breaks any."""
    v = F.col("__value")
    out = rows.withColumn("__value", parsed(F.col(body)))
    fails = [F.when(keys(v).isNull(), F.lit("object")), *violations(v, REQUESTS[kind])]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*fails))))
    value = F.struct(*[text_at(v, k).alias(name) for k, name in shown.items()])
    out = out.withColumn("violations", found).withColumn("request", F.when(F.size("violations") == 0, value))
    return out.drop("__value")


def messages(deliveries: DataFrame) -> DataFrame:
    """deliveries(body, ...) with message: job_id, stage and cursor; null for what is no message."""
    out = requests(deliveries, "message", "body", {"jobId": "job_id", "expectedStage": "stage", "cursor": "cursor"})
    return out.withColumnRenamed("request", "message").drop("violations")
