"""Mixing sources to target weights: Efraimidis-Spirakis sampling with plain DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, materialise

#: Weights that sources take in turn, in code-point order of their names.
SOURCE_WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: Most epochs of a source.
MAX_EPOCHS = 2
#: Documents in one range of the order in which prefix sums are taken, about.
RANGE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by the columns and the seed."""
    digest = F.md5(F.concat_ws("/", *[c.cast("string") for c in columns], F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of sizes(source, size): source_size, n_docs, target.

    Sources by code point (null last) weigh `weights` in turn.  A target stops at
    max_epochs times its source's size; what is cut off is shared again by weight.  Solved
    in closed form: by rising size/weight, the first k sources are at their stop, for the
    smallest k at which the rest, sharing what remains, stay below theirs."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(picks, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")))
    per = per.withColumn("stop", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("stop") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    per = per.withColumn("place", F.row_number().over(rising))
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(everything)
    target = F.least("stop", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, *, seed: str = "mix", weights=SOURCE_WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Choose whole documents and repeats of them until each source's words meet its target.

    docs: doc_id, text, source (further columns are left aside); quality: doc_id, weight
    above 0 for documents that should come earlier or later, 1 where absent.  Returns a row
    per input row: doc_id, source, size, source_size, target, copies, taken.

    A document's key is -ln(u)/weight.  Every source first gives its complete epochs; what
    remains of its target is filled in key order.  Documents are dealt into ranges of (source,
    key, ...) of even size, whatever the weights; the words of a range come after those of the
    source's ranges before, so a source with a third of all rows is many ranges.  The document on
    the edge counts if that brings the sum nearer to the target.  Null source: a source of its
    own; null or empty text: size 0, never above 0 words; equal rows: each is an entry of its own,
    with equal keys.  A column __row, where docs has one, is passed on.  Further columns are left
    aside, also if they are named as those above.  An empty table gives an empty result."""
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id().alias("__row")
    base = docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size"))
    if quality is not None:
        per_doc = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
        base = base.join(per_doc, "doc_id", "left")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    u = uniform(F.col("doc_id"), seed=seed)
    base = materialise(base.select("__row", "doc_id", "source", "size", (-F.log(u) / weight).alias("key")))
    order = ["key", "doc_id", "size", "__row"]
    ranges = base.repartitionByRange(max(1, math.ceil(base.count() / RANGE_ROWS)), "source", *order)
    rows = materialise(ranges.withColumn("part", F.spark_partition_id()))
    targets = source_targets(base, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # one row for each source in each range: what the source's ranges before hold
    sums = rows.groupBy("part", "source").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    named = targets.withColumnRenamed("source", "t_source")
    sums = sums.join(named, sums.source.eqNullSafe(named.t_source)).select(F.col("part").alias("s_part"), F.col("source").alias("s_source"), "before", "source_size", "target", "epochs", "rest")
    upto = F.sum("size").over(Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("upto", upto).join(sums, (F.col("part") == F.col("s_part")) & F.col("source").eqNullSafe(F.col("s_source")))
    extra = (F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")
    out = out.withColumn("copies", F.col("epochs") + extra)
    kept = ["__row"] if "__row" in docs.columns else []
    return out.select(*kept, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def quality_weights(labels: DataFrame, low: float = 0.25) -> DataFrame:
    """doc_id, weight: 1 for documents labelled good, `low` for those labelled bad."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.when(F.col("quality") >= 1, 1.0).otherwise(low).alias("weight"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs as often as mix_sources takes each, with the columns of docs.

    Rows are told apart by a key of their own, so null and repeated ids are taken as often as was
    decided for each row.  Documents without words are taken as the mix says: they count as 0."""
    rows = keyed(docs)
    copies = mix_sources(rows, quality, **options).filter(F.col("copies") > 0).select("__row", F.col("copies").alias("__copies"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__time")
    return rows.join(copies, "__row").select(*docs.columns, times).drop("__time")
