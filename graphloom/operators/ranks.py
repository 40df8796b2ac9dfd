"""Order at scale: rows dealt into ranges of an order, with the number of rows before each range.

A row's place is the number of rows in the ranges before its own, and its place within it.  No task sorts more than a
range, and a page of a cursor reads only the ranges that it meets."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import shared_folder

#: Rows of a range, about.
RANGE_ROWS = 100_000
#: Keys that go to the driver, about, to find where the first rows of an order end.
SAMPLE_KEYS = 10_000


class RankIndex:
    """An ordered table in the shared folder: rows with pos, their place in the order, from 0.

    Equal keys stand together, in no fixed order among themselves.  The driver holds a number per range.  An empty
    table has no ranges."""

    def __init__(self, rows: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.folder = shared_folder(self.spark)
        parts = max(1, math.ceil(rows.count() / range_rows))
        keyed = rows.withColumns({f"__k{i}": c for i, c in enumerate(order)})
        keys = [F.col(f"__k{i}") for i in range(len(order))]
        dealt = keyed.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id())
        within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)).cast("long") - 1
        dealt.withColumn("__at", within).drop(*[f"__k{i}" for i in range(len(order))]).write.partitionBy("__part").parquet(self.folder)
        sizes = self._table().groupBy("__part").count().collect() if parts else []
        self.parts, self.starts, total = [], [], 0
        for r in sorted(sizes, key=lambda r: r["__part"]):
            self.parts.append(r["__part"])
            self.starts.append(total)
            total += r["count"]
        self.total = total

    def _table(self) -> DataFrame:
        schema = self.schema.jsonValue()
        fields = [*schema["fields"], *({"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("__at", "long"), ("__part", "integer")))]
        return self.spark.read.schema(type(self.schema).fromJson({**schema, "fields": fields})).parquet(self.folder)

    def page(self, cursor: int = 0, size: int | None = None) -> DataFrame:
        """The rows at places from cursor on, `size` at most, with pos; only the ranges that hold them are read."""
        stop = self.total if size is None else min(self.total, cursor + size)
        first, last = max(bisect_right(self.starts, cursor) - 1, 0), bisect_right(self.starts, stop - 1)
        met = list(zip(self.parts, self.starts))[first:last] if cursor < stop else []
        starts = self.spark.createDataFrame(met, "__part int, __start long")  # a row per range: an expression per range would be too deep
        some = F.col("__part").between(met[0][0], met[-1][0]) if met else F.lit(False)
        rows = self._table().filter(some).join(F.broadcast(starts), "__part").withColumn("pos", F.col("__start") + F.col("__at"))
        return rows.filter((F.col("pos") >= cursor) & (F.col("pos") < stop)).drop("__part", "__at", "__start")


def first_n(rows: DataFrame, order: list[Column], n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The first n rows of an order, exactly, without a task that holds them all.

    A sample of about SAMPLE_KEYS keys says up to which key about n rows come; the rows up to there are counted, and
    the key is raised while they are too few.  Only those rows are ordered.  Of equal keys at the end any may stay."""
    total = rows.count()
    if n >= total:
        return rows
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    share = min(1.0, SAMPLE_KEYS / total)
    sample = rows.select(key.alias("k")).filter(F.rand(7) < share).orderBy("k").collect()  # bounded, whatever the table
    at = math.ceil(n / total * len(sample) * 1.1) + 5
    while at < len(sample):
        bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(sample[at]["k"], rows.select(key.alias("k")).schema["k"].dataType.fields)])
        some = rows.filter(key <= bound)
        if some.count() >= n:
            return RankIndex(some, order, range_rows).page(0, n).drop("pos")
        at = 2 * at
    return RankIndex(rows, order, range_rows).page(0, n).drop("pos")
