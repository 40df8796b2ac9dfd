"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, ship

#: Vectors that cluster centres are fit on at most (expected), at first and for each shard split again.
SAMPLE, SPLIT_SAMPLE = 20_000, 2_048
#: Vectors a shard should hold before overlap, centres of the first level and of a shard that is split
#: again, and vectors a graph is built over at most.
SHARD, CENTRES, CHILDREN, CAP = 500, 1_024, 64, 4_000
#: Shards that a vector belongs to at most on the first level and on those below, and how much further
#: than the nearest centre they may be (radians).
OVERLAP, BELOW, REACH = 4, 2, 0.35
#: Share of a shard's pairs that link from which it is compared whole: there the links themselves are a
#: fixed share of all pairs, so no search takes less.
DENSE = 0.1
#: Candidates and edges of a node, how eagerly an edge rules out others, and edges with those of others
#: towards the node.
POOL, DEGREE, ALPHA, FULL_DEGREE = 32, 16, 1.2, 48
#: Width of the greedy search, and how far below the threshold the range search still expands.
BEAM, SLACK = 24, 0.05
#: Queries of each half of the recall audit, the recall below which shards overlap more, the searches
#: that are tried, and the recall below which the last one gives way to an exact comparison in blocks.
AUDIT, WANTED_RECALL, TRIES, LEAST_RECALL = 256, 0.97, 3, 0.9


def centres_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means on the unit sphere; starts spread over the sample."""
    k = max(1, min(k, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return centres


def robust_prune(x: np.ndarray, pool: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Edges of every node from its pool (nearest first): an edge to p rules out c if
    ALPHA * distance(p, c) <= distance(node, c).  -1 where a node has fewer edges."""
    n, width = pool.shape
    alive = np.ones((n, width), dtype=bool)
    edges = np.full((n, DEGREE), -1, dtype=np.int64)
    far = 2 - 2 * near
    vectors = x[pool]
    at = np.arange(n)
    for slot in range(DEGREE):
        has = alive.any(axis=1)
        if not has.any():
            break
        pick = alive.argmax(axis=1)
        edges[has, slot] = pool[at, pick][has]
        between = 2 - 2 * np.einsum("nd,nkd->nk", vectors[at, pick], vectors)
        alive &= ALPHA * ALPHA * between > far
        alive[at, pick] = False
    return edges


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of every row of x, each edge both ways."""
    n = len(x)
    width = min(POOL, n - 1)
    if width < 1:
        return [np.zeros(0, dtype=np.int64) for _ in range(n)]
    pool, near = np.empty((n, width), dtype=np.int64), np.empty((n, width), dtype=x.dtype)
    for start in range(0, n, 1024):
        sims = x[start : start + 1024] @ x.T
        rows = np.arange(len(sims))
        sims[rows, start + rows] = -np.inf
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(sims, best, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        pool[start : start + len(sims)] = np.take_along_axis(best, order, axis=1)
        near[start : start + len(sims)] = np.take_along_axis(value, order, axis=1)
    edges = robust_prune(x, pool, near)
    i, j = np.nonzero(edges >= 0)
    one = np.unique(np.r_[i * n + edges[i, j], edges[i, j] * n + i])
    a, b = one // n, one % n
    order = np.lexsort((-np.einsum("kd,kd->k", x[a], x[b]), a))  # nearest first, so that hubs keep those
    lists = np.split(b[order], np.searchsorted(a, np.arange(1, n)))
    return [l[:FULL_DEGREE] for l in lists]


def range_search(x: np.ndarray, lists: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) found with cosine near the threshold or above, every row being a query; in
    parts of a bounded number of queries.

    Greedy search from the medoid with a beam; then every node found within SLACK of the
    threshold is expanded in turn until no new one turns up."""
    n = len(x)
    width = max(map(len, lists), default=0)
    if n < 2 or not width:
        return
    table = np.full((n, width), -1, dtype=np.int64)
    for i, l in enumerate(lists):
        table[i, : len(l)] = l
    medoid = int((x @ x.mean(axis=0)).argmax())
    for start in range(0, n, 512):
        out_q, out_v = [], []
        q = np.arange(start, min(n, start + 512))
        m = len(q)
        seen = np.zeros((m, n), dtype=bool)
        rows = np.arange(m)
        beam = np.full((m, BEAM), -1, dtype=np.int64)
        sims = np.full((m, BEAM), -np.inf, dtype=x.dtype)
        done = np.ones((m, BEAM), dtype=bool)
        beam[:, 0], sims[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        seen[:, medoid] = True
        active = rows
        while True:  # ends when every node of each beam was expanded
            todo = np.where(done[active], -np.inf, sims[active])
            pick = todo.argmax(axis=1)
            live = np.isfinite(todo[np.arange(len(active)), pick])
            active, pick = active[live], pick[live]
            if not len(active):
                break
            done[active, pick] = True
            nexts = table[beam[active, pick]]
            fresh = (nexts >= 0) & ~seen[active[:, None], nexts]
            a, b = np.nonzero(fresh)
            seen[active[a], nexts[a, b]] = True
            value = np.full(nexts.shape, -np.inf, dtype=x.dtype)
            value[a, b] = np.einsum("kd,kd->k", x[q[active[a]]], x[nexts[a, b]])
            all_s, all_b = np.hstack([sims[active], value]), np.hstack([beam[active], nexts])
            all_d = np.hstack([done[active], ~fresh])
            top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
            sims[active], beam[active], done[active] = (np.take_along_axis(z, top, axis=1) for z in (all_s, all_b, all_d))
        i, j = np.nonzero(sims >= threshold - SLACK)
        qi, vi = i, beam[i, j]
        visited = np.zeros((m, n), dtype=bool)
        visited[qi, vi] = True
        while len(qi):
            near = np.einsum("kd,kd->k", x[q[qi]], x[vi])
            hit = near >= threshold - 1e-5
            out_q.append(q[qi[hit]])
            out_v.append(vi[hit])
            grown_q, grown_v = [], []
            for s in range(0, len(qi), 20_000):
                nexts = table[vi[s : s + 20_000]]
                a, b = np.nonzero(nexts >= 0)
                key = np.unique(qi[s : s + 20_000][a] * n + nexts[a, b])
                gq, gv = key // n, key % n
                new = ~visited[gq, gv]
                gq, gv = gq[new], gv[new]
                visited[gq, gv] = True
                for t in range(0, len(gq), 50_000):
                    cq, cv = gq[t : t + 50_000], gv[t : t + 50_000]
                    close = np.einsum("kd,kd->k", x[q[cq]], x[cv]) >= threshold - SLACK
                    grown_q.append(cq[close])
                    grown_v.append(cv[close])
            qi, vi = (np.concatenate(g) if g else np.zeros(0, dtype=np.int64) for g in (grown_q, grown_v))
        qs, vs = np.concatenate(out_q or [q]), np.concatenate(out_v or [q])
        keep = qs != vs
        yield qs[keep], vs[keep]


def _unit(raw: list) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = np.asarray([np.asarray(v, dtype=np.float64) for v in raw])
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _summary(node, times, homes, here, x, parts, threshold) -> pd.DataFrame:
    """Links of a shard's nodes from parts of pairs, verified in double precision; each pair counts in
    the first shard that both share.  Per node the sum of linked copies and one node of its component here."""
    links = np.zeros(len(node), dtype=np.int64)
    at = np.argsort(node)
    low = node.copy()  # smallest node reachable within these rows
    own = np.arange(len(node))
    for qs, vs in parts:
        exact = np.concatenate([np.einsum("kd,kd->k", x[qs[s : s + 50_000]], x[vs[s : s + 50_000]]) >= threshold for s in range(0, len(qs), 50_000)] or [np.zeros(0, bool)])
        qs, vs = qs[exact], vs[exact]
        first = np.full(len(qs), np.iinfo(np.int64).max)
        for i in range(homes.shape[1]):
            h = homes[qs, i]
            shared = (homes[vs] == h[:, None]).any(axis=1) & (h >= 0)
            first = np.where(shared, np.minimum(first, h), first)
        mine = first == here
        links += np.bincount(qs[mine], weights=times[vs[mine]], minlength=len(node)).astype(np.int64)
        # this part's pairs and what the parts before joined, as a star around each component
        star = at[np.searchsorted(node[at], low)]
        a, b = np.r_[qs, own], np.r_[vs, star]
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = np.minimum(new, new[at[np.searchsorted(node[at], new)]])
            if (new == low).all():
                break
            low = new
    return pd.DataFrame({"node": node, "links": links, "root": low})


def _homes(column) -> np.ndarray:
    width = max(map(len, column))
    return np.array([list(h) + [-1] * (width - len(h)) for h in column], dtype=np.int64)


RESULT = "node long, links long, root long"


def _nearest(x: np.ndarray, centres: np.ndarray, overlap: int, reach: float) -> list[np.ndarray]:
    """Of every row of x the nearest centre and up to overlap - 1 more that are little further."""
    near = np.arccos(np.clip(x.astype(np.float32) @ centres.T, -1, 1))
    k = min(overlap, near.shape[1])
    best = np.argsort(near, axis=1, kind="stable")[:, :k]
    low = near.min(axis=1)
    return [b[near[i, b] <= low[i] + reach] for i, b in enumerate(best)]


def _split(members: DataFrame, large: DataFrame, threshold: float, overlap: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """Members of the shards in large(shard, size) dealt to shards below them, and the shards that
    are dense instead.  Each is split around centres fit on a bounded sample of its own."""
    some = members.join(large, "shard")
    chosen = some.filter(F.pmod(F.xxhash64("node", "shard"), F.lit(1_000_000)) < F.lit(1e6 * SPLIT_SAMPLE) / F.col("size")).select("shard", "size", "vector")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(list(rows["vector"]))
        part = x[:1024]  # in no order: rows come by a hash
        links = ((part @ part.T >= threshold).sum() - len(part)) / max(1, len(part) * (len(part) - 1))
        k = min(CHILDREN, max(16, math.ceil(rows["size"].iloc[0] / SHARD)))
        return pd.DataFrame({"shard": [key[0]], "size": [int(rows["size"].iloc[0])], "dense": [bool(links >= DENSE)], "centres": [centres_of(x, k).astype(np.float32).tobytes()]})

    fitted = materialise(chosen.groupBy("shard").applyInPandas(fit, "shard long, size long, dense boolean, centres binary"))
    sparse = fitted.filter("NOT dense").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / CAP).cast("long"))))
    rows = some.join(fitted.filter("NOT dense").select("shard"), "shard", "left_semi").withColumn("salt", F.pmod(F.xxhash64("node"), F.floor(F.col("size") / CAP).cast("long") + 1))

    def deal(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(centre):
            return pd.DataFrame({"node": [], "shard": []}).astype("int64")
        x = _unit(list(rows["vector"]))
        where = _nearest(x, np.frombuffer(centre["centres"].iloc[0], dtype=np.float32).reshape(-1, x.shape[1]), overlap, reach)
        node = np.repeat(rows["node"].to_numpy(), [len(w) for w in where])
        return pd.DataFrame({"node": node, "shard": (centre["shard"].iloc[0] + CENTRES) * CHILDREN + np.concatenate(where)})

    dealt = rows.select("shard", "salt", "node", "vector").groupBy("shard", "salt").cogroup(sparse.groupBy("shard", "salt")).applyInPandas(deal, "node long, shard long")
    return dealt, fitted.filter("dense").select("shard")


def sizes_of(placed: DataFrame) -> DataFrame:
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))


def _compared(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """RESULT rows of the shards in sizes(shard, size), of any size: all pairs of bounded chunks, exactly.  A task
    holds two chunks, and returns a row per member."""
    chunks = F.ceil(F.col("size") / (CAP // 2))
    rows = members.join(sizes, "shard").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks))
    sides = F.transform(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long")), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    rows = rows.withColumn("side", F.explode(sides)).select("shard", "side.i", "side.j", "chunk", "node", "times", "vector", "homes")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, i, j = key
        x = _unit(list(rows["vector"]))
        chunk = rows["chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        qs, vs = [], []
        for s in range(0, len(left), 512):
            part = left[s : s + 512]
            a, b = np.nonzero(x[part] @ x[right].T >= threshold)
            qs.append(part[a])
            vs.append(right[b])
        qs, vs = np.concatenate(qs or [left]), np.concatenate(vs or [left])
        keep = qs != vs
        qs, vs = qs[keep], vs[keep]
        if i != j:
            qs, vs = np.r_[qs, vs], np.r_[vs, qs]
        return _summary(rows["node"].to_numpy(), rows["times"].to_numpy(), _homes(rows["homes"]), shard, x, [(qs, vs)], threshold)

    return rows.groupBy("shard", "i", "j").applyInPandas(compare, RESULT)


def _all_compared(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """RESULT rows of classes without any index: the exact way where searches find too little."""
    members = classes.withColumn("shard", F.lit(0).cast("long")).withColumn("homes", F.array(F.lit(0).cast("long")))
    sizes = classes.sparkSession.range(1).select(F.lit(0).cast("long").alias("shard"), F.lit(n).cast("long").alias("size"))
    return materialise(_compared(members, sizes, threshold))


def _shards(classes: DataFrame, n: int, threshold: float, overlap: int, below: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """(node, shard) of overlapping shards of at most CAP vectors, and of dense shards of any size.

    The first level's centres are fit on a bounded sample of all; a shard above CAP is split again, and so
    on, so the number of centres grows with the table while each fit and each group stays bounded."""
    spark = classes.sparkSession
    share = min(1.0, SAMPLE / max(n, 1))
    sample = classes.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share * 1e6).select("vector").toPandas()["vector"]
    if not len(sample):
        sample = classes.select("vector").limit(1).toPandas()["vector"]
    centres = spark.sparkContext.broadcast(centres_of(_unit(list(sample)), min(CENTRES, math.ceil(n / SHARD))).astype(np.float32))

    @F.pandas_udf("array<long>")
    def homes(vectors: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_unit(list(vectors)), centres.value, overlap, reach) if len(vectors) else [], dtype=object)

    placed = materialise(classes.select("node", F.explode(homes("vector")).alias("shard")))
    done = dense = None
    for _ in range(8):  # 64 centres a level: more than any table needs
        large = materialise(sizes_of(placed)).filter(F.col("size") > CAP)
        small = placed.join(large.select("shard"), "shard", "left_anti").select("node", "shard")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            break
        vectors = placed.join(large.select("shard"), "shard", "left_semi").join(classes.select("node", "vector"), "node")
        dealt, whole = _split(vectors, large, threshold, below, reach)
        kept = placed.join(whole, "shard", "left_semi").select("node", "shard")
        done = done.unionByName(kept)
        dense = whole if dense is None else dense.unionByName(whole)
        placed = materialise(dealt)
    else:  # what no centres take apart, as vectors of one direction, is compared whole
        whole = sizes_of(placed).filter(F.col("size") > CAP).select("shard")
        done = done.unionByName(placed.select("node", "shard"))
        dense = whole if dense is None else dense.unionByName(whole)
    empty = spark.createDataFrame([], "shard long")
    return done, empty if dense is None else dense


def _links(classes: DataFrame, n: int, threshold: float, overlap: int, below: int, reach: float) -> DataFrame:
    """RESULT rows for classes(node, times, vector) of one dimension."""
    placed, dense = _shards(classes, n, threshold, overlap, below, reach)
    placed, dense = materialise(placed), materialise(dense)
    homes = placed.groupBy("node").agg(F.collect_list("shard").alias("homes"))  # a few for each
    members = materialise(placed.join(classes.join(homes, "node"), "node"))
    sizes = sizes_of(members)
    usual = members.join(dense, "shard", "left_anti")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x, node = _unit(list(rows["vector"])).astype(np.float32), rows["node"].to_numpy()
        return pd.DataFrame({"node": node, "near": [node[l] for l in build_graph(x)]})

    graph = usual.groupBy("shard").applyInPandas(build, "node long, near array<long>")
    graph = materialise(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, node = _unit(list(rows["vector"])), rows["node"].to_numpy()
        order = np.argsort(node)
        lists = []
        for near in rows["near"]:
            near = np.asarray(near if near is not None else [], dtype=np.int64)
            at = np.minimum(np.searchsorted(node[order], near), len(node) - 1)
            lists.append(order[at[node[order][at] == near]] if len(near) else near)
        parts = range_search(x.astype(np.float32), lists, threshold)
        return _summary(node, rows["times"].to_numpy(), _homes(rows["homes"]), key[0], x, parts, threshold)

    found = usual.join(graph, "node", "left").groupBy("shard").applyInPandas(search, RESULT)

    # dense shards, as around one very common vector
    exact = _compared(members, sizes.join(dense, "shard", "left_semi"), threshold)
    return materialise(found.unionByName(exact))


def audit_recall(classes: DataFrame, links: DataFrame, threshold: float, n: int, queries: int = AUDIT) -> float:
    """Share of the true links that were found, of about `queries` classes among all and as many among
    those with links, chosen by a hash; the smaller of the share of all their links and the mean of
    their shares.  The queries' vectors are broadcast (their number is bounded) and all classes scanned."""
    linked = links.groupBy("node").agg(F.sum("links").alias("links")).filter("links > 0")
    m = linked.count()
    mark = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1_000_000_000))
    some = classes.select("node").filter(mark < 1e9 * min(1.0, queries / max(n, 1))).union(linked.select("node").filter(mark < 1e9 * min(1.0, queries / max(m, 1)))).distinct()
    asked = classes.select("node", "vector").join(some, "node").toPandas()
    if not len(asked):
        return 1.0
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((asked["node"].to_numpy(), _unit(list(asked["vector"]))))

    def count(batches):
        node, q = shared.value
        total = np.zeros(len(node), dtype=np.int64)
        for rows in batches:
            if len(rows):
                close = _unit(list(rows["vector"])) @ q.T >= threshold
                close &= rows["node"].to_numpy()[:, None] != node[None, :]
                total += (close * rows["times"].to_numpy()[:, None]).sum(axis=0)
        yield pd.DataFrame({"node": node, "truth": total})

    truth = classes.mapInPandas(count, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    got = truth.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    found = F.least("truth", F.coalesce("links", F.lit(0)))
    r = got.filter("truth > 0").agg(F.sum("truth").alias("t"), F.sum(found).alias("g"), F.avg(found / F.col("truth")).alias("mean")).first()
    return min(r["g"] / r["t"], r["mean"]) if r["t"] else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding).

    Equal vectors are one class with a number of copies.  Classes go to overlapping shards around
    k-means centres that are fit on bounded samples, level below level until a shard holds CAP vectors
    at most.  A graph is built on each shard, the adjacency lists of a node are united over its
    shards, and every class is searched from the medoid of each of its shards.  Links are verified
    in double precision and count once, in the first shard that both ends share; a shard returns one
    row per member, never pairs.  A shard above CAP in which a tenth of all pairs link can't be
    searched for less than it is compared for, so it is compared whole, in chunks.  Each search is
    audited: a bounded set of queries is compared with all rows; below WANTED_RECALL shards overlap
    more and the search runs again; where the last one stays below LEAST_RECALL all are compared in blocks.

    Null, empty, all-zero vectors and those with null or non-finite components: n_links 0, a
    component of their own.  Vectors of different dimensions don't link.  Equal rows count as
    rows; null vec_ids take part but name no component with other ids; further columns are left aside,
    also if they are named as those above; an empty table gives an empty result."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding")
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = materialise(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(v, lambda x: x.cast("double"))).alias("vector")))
    classes = rows.filter(F.col("vector").isNotNull()).groupBy("vector").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("smallest"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    found = None
    for dim, n in classes.groupBy("dim").count().collect():
        part = classes.filter(F.col("dim") == dim).select("node", "times", "vector")
        overlap, below, reach = OVERLAP, BELOW, REACH
        for _ in range(TRIES):
            links = _links(part, n, threshold, overlap, below, reach)
            recall = audit_recall(part, links, threshold, n)
            if recall >= WANTED_RECALL:
                break
            overlap, below, reach = 2 * overlap, 2 * below, 1.5 * reach
        if recall < LEAST_RECALL:
            links = _all_compared(part, n, threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    edges = found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_components(edges)
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "vector", "times", "smallest").join(total, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("vector").alias("__vector"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.join(named, F.col("vector") == F.col("__vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
