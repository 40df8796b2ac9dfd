"""Exact top-k inner products by vector-approximation files."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

#: Vectors in a data block, blocks in a slice, and vectors in the largest block of queries.
BLOCK, SLICE, QUERY_BLOCK = 4096, 64, 16_384
#: Bits of a quantised component.
BITS = 8
#: Queries whose scores with a block are held at once.
ROWS_AT_ONCE = 256


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """rid, vec_id, dim, body: floor(scale * x) of every component as 64-bit integers in a binary.
    Vectors that are null or empty or hold null or non-finite components are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(x.isNotNull() & (F.size(x) > 0) & ~bad & F.col("vec_id").isNotNull())
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), ints.alias("ints"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())

    @F.pandas_udf("binary")
    def packed(ints: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<i8").tobytes() for v in ints])

    return materialise(rows.select("rid", "vec_id", "dim", packed("ints").alias("body")))


def _blocks(rows: DataFrame, n: int, size: int, quantise: bool) -> DataFrame:
    """The n rows of a table as blocks of about `size` vectors of one dimension; as cells, if asked."""

    def build(batches):
        held: dict[int, list] = {}

        def row(dim, part):
            ids = np.array([r for r, _ in part], dtype="<i8")
            v = np.frombuffer(b"".join(b for _, b in part), dtype="<i8").reshape(len(part), dim)
            low, step, body = np.zeros(dim, dtype="<i8"), np.ones(dim, dtype="<i8"), v
            if quantise:
                low = v.min(axis=0)
                step = -(-(v.max(axis=0) - low + 1) >> BITS)
                body = ((v - low) // step).astype(np.uint8)
            return {"block": int(ids[0]), "dim": dim, "row_ids": ids.tobytes(), "body": body.tobytes(), "low": low.tobytes(), "step": step.tobytes()}

        for batch in batches:
            out = []
            for rid, dim, body in zip(batch["rid"], batch["dim"], batch["body"]):
                part = held.setdefault(dim, [])
                part.append((rid, body))
                if len(part) >= size:
                    out.append(row(dim, held.pop(dim)))
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([row(d, p) for d, p in held.items()])

    spread = rows.select("rid", "dim", "body").repartition(max(1, math.ceil(n / size / 4)))
    return materialise(spread.mapInPandas(build, "block long, dim int, row_ids binary, body binary, low binary, step binary"))


def scan_cells(queries: np.ndarray, q_ids: np.ndarray, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """Queries against the cells of a slice's blocks: candidates with bounds of their scores.

    Of every query the k largest lower bounds met so far are kept; a candidate stays if its upper
    bound reaches the smallest of those, at first as they stand and at last as they ended."""
    queries = queries.astype(np.float64)
    size = np.abs(queries).sum(axis=1)
    best = np.full((len(queries), k), -np.inf)
    kept: list[tuple[np.ndarray, ...]] = []
    for b in blocks.itertuples():
        dim = queries.shape[1]
        cells = np.frombuffer(b.body, dtype=np.uint8).reshape(-1, dim)
        low, step = (np.frombuffer(x, dtype="<i8").astype(np.float64) for x in (b.low, b.step))
        half = (step - 1) / 2
        middle = low + cells * step + half
        v_ids = np.frombuffer(b.row_ids, dtype="<i8")
        # the last term covers the rounding of sums in double precision
        slack = np.abs(queries) @ half + 2**-40 * (1 + size * np.abs(middle).max(initial=0))
        for at in range(0, len(queries), ROWS_AT_ONCE):
            rows = slice(at, at + ROWS_AT_ONCE)
            guess = queries[rows] @ middle.T
            guess[q_ids[rows, None] == v_ids[None, :]] = -np.inf
            most, least = guess + slack[rows, None], guess - slack[rows, None]
            top = np.partition(least, least.shape[1] - k, axis=1)[:, -k:] if least.shape[1] > k else least
            best[rows] = np.sort(np.hstack([best[rows], top]), axis=1)[:, -k:]
            i, j = np.nonzero((most >= best[rows, :1]) & np.isfinite(guess))
            kept.append((i + at, v_ids[j], least[i, j], most[i, j]))
    i, v, least, most = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, int),) * 4
    good = most >= best[i, 0]
    return pd.DataFrame({"q_rid": q_ids[i[good]], "rid": v[good], "least": least[good], "most": most[good]})


def inner_products(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Integer inner products of pairs of vectors, all of one length in one product."""
    size = np.array([len(x) for x in left])
    out = np.zeros(len(left), dtype=np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        a, b = (np.frombuffer(b"".join([side[i] for i in at]), dtype="<i8").reshape(len(at), -1) for side in (left, right))
        out[at] = np.einsum("nd,nd->n", a, b)
    return out


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every`, the k
    other rows with the largest integer inner product, ties to the smaller vec_id.

    Phase one scans cells of BITS bits a component: blocks of queries against slices of SLICE blocks of
    data.  A slice returns what may be among a query's k best by the bounds it has seen; the
    query's kth largest lower bound over all slices then settles which of these stay.  Phase two
    reads exact vectors in the order of their upper bounds, k at first and then twice as many each time,
    until no unread upper bound of a query reaches its kth exact score.  Each block, slice and task has
    a bounded size, whatever a table's size.  Rows with the same vec_id are rows of their own; null
    vec_ids and vectors take no part; only vectors of one dimension are compared; further columns are
    left aside; an empty table gives an empty result."""
    spark = vectors.sparkSession
    ship(spark)
    rows = integer_vectors(vectors, scale)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n, n_q = rows.count(), asked.count()
    data = _blocks(rows, n, BLOCK, True)
    tasks = 4 * spark.sparkContext.defaultParallelism
    queries = _blocks(asked, n_q, min(QUERY_BLOCK, max(256, math.ceil(n_q / tasks))), False)
    # the stated query set against all rows, in blocks: every data block goes once to each block of queries
    slices = max(1, math.ceil(n / (BLOCK * SLICE)))
    q_blocks = queries.select(F.col("block").alias("q_block"), "dim")  # 12 bytes for each block of queries
    left = data.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))).join(F.broadcast(q_blocks), "dim")
    right = queries.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).withColumnRenamed("block", "q_block")

    def scan(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"q_rid": [], "rid": [], "least": [], "most": []}).astype({"q_rid": "int64", "rid": "int64"})
        one = q.iloc[0]
        body = np.frombuffer(one["body"], dtype="<i8").reshape(-1, int(one["dim"]))
        return scan_cells(body, np.frombuffer(one["row_ids"], dtype="<i8"), d, k)

    found = right.groupBy("q_block", "slice").cogroup(left.groupBy("q_block", "slice")).applyInPandas(scan, "q_rid long, rid long, least double, most double")
    found = materialise(found)
    by_least = Window.partitionBy("q_rid").orderBy(F.desc("least"))
    bound = found.withColumn("place", F.row_number().over(by_least)).filter(F.col("place") == k).select("q_rid", F.col("least").alias("bound"))
    by_most = Window.partitionBy("q_rid").orderBy(F.desc("most"), "rid")
    left_over = found.join(bound, "q_rid", "left").filter(F.col("bound").isNull() | (F.col("most") >= F.col("bound")))
    left_over = materialise(left_over.withColumn("place", F.row_number().over(by_most)).select("q_rid", "rid", "most", "place"))
    asked = asked.select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("query_id"), F.col("body").alias("q_body"))

    @F.pandas_udf("long")
    def inner(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(inner_products(left.tolist(), right.tolist()))

    def read(some: DataFrame) -> DataFrame:
        return some.join(asked, "q_rid").join(rows.select("rid", "vec_id", "body"), "rid").select("q_rid", "query_id", "vec_id", "rid", inner("q_body", "body").alias("score"))

    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    best, done, upto, todo = None, 0, k, left_over
    while True:
        new = read(todo.filter((F.col("place") > done) & (F.col("place") <= upto)).select("q_rid", "rid"))
        ranked = (new if best is None else best.drop("rank").unionByName(new)).withColumn("rank", F.row_number().over(order))
        best = materialise(ranked.filter(F.col("rank") <= k))
        done, upto = upto, 2 * upto
        kth = best.filter(F.col("rank") == k).select("q_rid", F.col("score").alias("kth"))
        todo = left_over.filter(F.col("place") > done).join(kth, "q_rid").filter(F.col("most") >= F.col("kth"))
        if todo.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")
