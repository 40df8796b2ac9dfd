"""Helpers shared by the training-data operators: shared scratch folder, materialised
tables, shipping of this package to executors, word indexes and connected components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as a Java and Python regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker at most: texts' lengths vary widely, so rows alone bound nothing.
BATCH_BYTES = 8 << 20
#: The session option that sets another bound.
BATCH_OPTION = "graphloom.batch.bytes"
#: That bound, and the rows that a Parquet reader decodes at once, in sparing stages.
SPARING_BYTES, SPARING_ROWS = 2 << 20, 512
#: Python workers of sparing stages give freed buffers back to the system instead of keeping them for others.
SPARING_WORKERS = {"MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that task functions can be imported there by name, and bound the
    session's Arrow batches by bytes."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get(BATCH_OPTION, str(BATCH_BYTES)))
    if getattr(sc, "_graphloom_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "graphloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._graphloom_shipped = True


def sparing(stage):
    """A stage (spark, ...) -> DataFrame whose tasks hold less at once, at some cost of time; its rows are the same.

    For stages that run one after the other on the same executors, where heap and workers keep what an earlier
    stage took.  The result is lazy, so the bounds of batches and readers stay set in the session; an operator
    called by itself sets its own for batches.  The workers' environment goes with the stage's functions alone."""

    @functools.wraps(stage)
    def build(spark: SparkSession, *args) -> DataFrame:
        before, bound = dict(spark.sparkContext.environment), spark.conf.get(BATCH_OPTION, None)
        spark.sparkContext.environment.update(SPARING_WORKERS)
        spark.conf.set(BATCH_OPTION, str(SPARING_BYTES))
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SPARING_ROWS))
        try:
            return stage(spark, *args)
        finally:
            spark.conf.set(BATCH_OPTION, bound) if bound else spark.conf.unset(BATCH_OPTION)
            spark.sparkContext.environment.clear()
            spark.sparkContext.environment.update(before)

    return build


def scratch(spark: SparkSession) -> str:
    """A new folder name under the folder that the cluster shares (spark.checkpoint.dir).  Without that setting
    a folder of this machine serves a local session alone, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


#: Folders of intermediate tables that this driver had written and not yet deleted.
_tables: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and every later
    use reads one fixed version even if an executor is lost."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def only_result(spark: SparkSession, build) -> DataFrame:
    """materialise(build()), and delete the intermediate tables that this took."""
    begun = len(_tables)
    out = materialise(build())
    for path in _tables[begun:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _tables[begun:-1]
    return out


#: Bytes, about, that a Python worker keeps of what it computed for words or pieces.
KEEP_BYTES = 40 << 20
#: What an entry of such a dictionary takes besides the characters of its key.
ENTRY_BYTES = 160

_held: dict = {}


def held(key, make):
    """The object of this key that a Python worker keeps between batches and tasks.  It keeps one
    alone: workers outlive a stage, so another stage's object is let go first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Known(dict):
    """key -> value computed when first asked for; emptied when KEEP_BYTES are held, which only
    costs time."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.room = compute, KEEP_BYTES

    def __missing__(self, key):
        self.room -= len(key) + ENTRY_BYTES
        if self.room < 0:
            self.clear()
            self.room = KEEP_BYTES
        value = self[key] = self.compute(key)
        return value


class WordIndex(dict):
    """word -> running number; words seen for the first time wait in .new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.bytes = 0

    def __missing__(self, word):
        i = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word) + ENTRY_BYTES
        return i


class Recent(dict):
    """Values computed for keys in bulk, of which the recently used are kept: when KEEP_BYTES are held,
    those not asked for since half as many were are let go.  Forgetting only costs time."""

    def __init__(self, compute, entry_bytes: int = ENTRY_BYTES):
        super().__init__()
        self.compute, self.entry_bytes, self.older, self.bytes = compute, entry_bytes, {}, 0

    def need(self, keys: set) -> None:
        """Hold all of keys from now until the next call."""
        if self.bytes > KEEP_BYTES // 2:
            self.older, self.bytes = dict(self), 0
            self.clear()
        new = keys.difference(self)
        if not new:
            return
        self.bytes += sum(map(len, new)) + self.entry_bytes * len(new)
        if self.older:
            again = new.intersection(self.older)
            self.update(zip(again, map(self.older.__getitem__, again)))
            new -= again
        new = list(new)
        self.update(zip(new, self.compute(new)))


def keyed(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with a column that tells its rows apart: doc_id itself if no row lacks or shares it, else
    numbers that are written with the rows, so that they stay as they are."""
    odd = docs.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node reachable.

    Every round each node takes the smallest label among its neighbours and itself, then
    follows its label's own label (pointer jumping), so chains shorten exponentially.
    Sums of labels are not needed: the loop ends when no label fell.  Each round is a
    written table; nothing but one count goes to the driver."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = materialise(labels)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("hop"))
        up = labels.select(F.col("node").alias("hop"), F.col("root").alias("far"))
        new = materialise(step.join(up, "hop", "left").select("node", "old", F.least("hop", F.coalesce("far", "hop")).alias("root")))
        moved = new.filter(F.col("root") < F.col("old")).limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
