"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, connected_components, held, keyed, materialise, ship

#: Cells of the table of shingle frequencies: a fixed size, 4 bytes each while counting and 2 when sent out.
CELLS = 1 << 20
#: Parts of that table in transit, and how many tasks' counts of a part are summed at once.
CHUNKS, FAN_IN = 16, 64
#: Hash ranges by which the suffix filter compares two sets.
RANGES = 32
#: Entries of a list of one shingle that one part of its self-join takes, about.
LIST_PART = 2048
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of a text's shingles in order, repeats included.  ASCII letters are
    lowered and words split at ASCII white space; fewer words than `width` make one shingle."""
    words = text.encode().lower().split() if text else []
    known = held("shingles", lambda: Known(xxhash.xxh64_intdigest))
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    n = len(words) - size + 1 if words else 0
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * _PRIME
        h ^= h >> np.uint64(31)
    return h


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Rank (0 rarest to 65535) of every cell of shingle hashes, counted over all documents.

    Each task counts its texts into a table of fixed size; tables are summed part by part in
    steps of FAN_IN, so neither a summing task nor the driver holds more with more tasks."""

    def count(batches):
        part, table, waiting, held = TaskContext.get().partitionId(), np.zeros(CELLS, dtype=np.uint32), [], 0
        for batch in batches:
            for text in batch["text"]:
                h = shingle_hashes(text, width)
                waiting.append((h >> np.uint64(44)).astype(np.int32))
                held += len(h)
                if held > 2_000_000:
                    table += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
                    waiting, held = [], 0
        if waiting:
            table += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
        cells = table.reshape(CHUNKS, -1)
        yield pd.DataFrame({"chunk": range(CHUNKS), "part": part, "cells": [zlib.compress(c.tobytes(), 1) for c in cells]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // CHUNKS, dtype=np.uint64)
        for c in rows["cells"]:
            raw = zlib.decompress(c)
            total += np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 * len(total) else np.uint64)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1] // FAN_IN, "cells": [zlib.compress(total.tobytes(), 1)]})

    schema = "chunk int, part int, cells binary"
    parts = docs.select("text").mapInPandas(count, schema)
    for _ in range(2):
        parts = parts.groupBy("chunk", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
    parts = parts.groupBy("chunk").applyInPandas(add, schema)
    counts = np.zeros((CHUNKS, CELLS // CHUNKS), dtype=np.uint64)
    for r in parts.collect():
        counts[r["chunk"]] = np.frombuffer(zlib.decompress(r["cells"]), dtype=np.uint64)
    counts = counts.ravel()
    shift = max(0, int(counts.max()).bit_length() - 16)
    return (counts >> np.uint64(shift)).astype(np.uint16)


def shingle_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs with a struct column __set: n, sig (hash of the whole set), prefix, ranges.

    prefix: the set's rarest shingles, so many that two sets that link share one; the order
    is by the frequency of a shingle's cell and then by hash, the same for all sets.
    ranges: how many shingles fall into each of 32 ranges of another hash."""
    ship(docs.sparkSession)
    rank = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, width))

    @F.pandas_udf("n int, sig binary, prefix array<long>, ranges array<short>")
    def summarise(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            h = np.unique(shingle_hashes(text, width))
            n = len(h)
            if not n:
                rows.append((0, None, None, None))
                continue
            order = (rank.value[h >> np.uint64(44)].astype(np.uint64) << np.uint64(48)) | (h & np.uint64(0xFFFFFFFFFFFF))
            keep = n - -(-percent * n // 100) + 1
            first = np.sort(np.partition(order, keep - 1)[:keep] if keep < n else order)
            ranges = np.bincount((h & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)
            rows.append((n, xxhash.xxh128_digest(h.tobytes()), first.view(np.int64), np.minimum(ranges, 32767).astype(np.int16)))
        return pd.DataFrame(rows, columns=["n", "sig", "prefix", "ranges"]).astype({"n": "int32"})

    return docs.withColumn("__set", summarise("text"))


def _alike(left: str, right: str, percent: int):
    """What two entries of a shingle's list must meet: the length and positional filters.

    A pair that links meets them at its first common shingle, before which nothing matches,
    so shared shingles can only be this one and those after it in both sets."""
    a, b = {k: F.col(f"{left}.{k}") for k in ("n", "pos")}, {k: F.col(f"{right}.{k}") for k in ("n", "pos")}
    need = percent * (a["n"] + b["n"])  # (100 + percent) * overlap must reach it
    room = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & ((100 + percent) * room >= need)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that do link: suffix filter, then one exact comparison of each pair.

    Only the nodes of the pairs left have their whole sets written, once each, as sorted hashes; a pair
    is then two such arrays that the JVM intersects, row by row, so no batch of texts is ever held."""
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("ranges").alias(f"r_{k}"))
    apart = F.aggregate(F.zip_with("r_a", "r_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    # sets that link differ in n_a + n_b - 2 i shingles at most, and in as many as their ranges at least
    most = F.col("n_a") + F.col("n_b") - 2 * F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    pairs = materialise(pairs.join(of("a"), "a").join(of("b"), "b").filter(apart <= most).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()

    @F.pandas_udf("array<long>")
    def whole_set(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], dtype=object)

    texts = docs.select(F.col("__row").alias("node"), "text").join(wanted, "node")
    sets = materialise(texts.select("node", whole_set("text").alias("h")))
    left, right = (sets.select(F.col("node").alias(k), F.col("h").alias(f"h_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return materialise(both.filter((100 + percent) * common >= percent * (F.size("h_a") + F.size("h_b"))).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents by links between their shingle sets: one row per row of docs(doc_id, text).

    Returns doc_id, n_shingles, sig (of the set), component_id (the smallest doc_id reachable by links).
    Two sets link when 100 * intersection >= percent * union.  Rows with equal sets are one node.

    Nodes meet in the lists of their prefix shingles.  First every node is compared with one
    leader: of the entries with the fewest rarer shingles in its lists, the one it meets most.  Then, in
    lists that still hold several components, all pairs across components are compared that pass the
    filters and were not compared before; a long list is dealt out in parts.  Pairs inside one component
    need no comparison, so a group of thousands of near copies costs about one comparison a member, and
    no link between components is lost.

    Null, empty and blank texts: no shingles, linked with nothing, sig null.  Equal rows: equal results.
    A null doc_id takes part but is no component_id unless it is alone.  Further columns are left aside;
    an empty table gives an empty result."""
    return _classes(keyed(docs.select("doc_id", "text")), width, percent).drop("__row", "__first")


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates of docs(__row, doc_id, text) with __row and whether the row is its class's first."""
    rows = materialise(shingle_sets(docs.select("__row", "doc_id", "text"), width, percent).select("__row", "doc_id", "__set.*"))
    some = rows.filter("n > 0")
    nodes = some.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("__row").alias("node"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).getField("__row").alias("first_row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges"))
    nodes = materialise(nodes)
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("pos", "node", "n")).alias("lead")).filter("size > 1")
    shared = materialise(entries.join(lists, "token"))
    meet = shared.alias("x").filter((F.col("x.node") != F.col("x.lead.node")) & _alike("x", "x.lead", percent))
    meet = meet.groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    first = materialise(meet.groupBy("a").agg(F.max_by("b", F.struct("times", F.col("b"))).alias("b")))
    edges = _verified(first, nodes, docs, width, percent)
    labels = connected_components(edges)
    place = shared.select("token", "node", "n", "pos").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = place.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / LIST_PART).alias("parts")).filter("low < high")
    place = materialise(place.join(open_lists.select("token", "parts"), "token"))
    x = place.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("x")
    y = place.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _alike("x", "y", percent))
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified(across.join(tried, ["a", "b"], "left_anti"), nodes, docs, width, percent)
    labels = connected_components(edges.union(more))
    named = nodes.select("node", "sig", "doc_id", "first_row").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # one node stands for its class: that with the smallest doc_id, and its first row with it
    best = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).getField("node").alias("best"))
    named = named.join(best, "root").select(F.col("sig").alias("__sig"), "component_id", F.when(F.col("node") == F.col("best"), F.col("first_row")).alias("first_row"))
    out = rows.select("__row", "doc_id", "n", "sig").join(named, F.col("sig") == F.col("__sig"), "left")
    is_first = F.col("sig").isNull() | F.coalesce(F.col("__row") == F.col("first_row"), F.lit(False))
    return out.select("__row", "doc_id", F.col("n").cast("long").alias("n_shingles"), "sig", F.coalesce("component_id", "doc_id").alias("component_id"), is_first.alias("__first"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each class of near_duplicates: a row with the class's smallest
    doc_id, one without a doc_id only where no row of the class has one.

    Rows are told apart by a key of their own, so null and repeated ids, and one id on different texts,
    keep one row a class as well.  Null, empty and blank texts link with nothing and all stay.  An empty
    table gives an empty result; columns of any name pass through."""
    rows = keyed(docs)
    kept = _classes(rows, width, percent).filter("__first").select("__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)
