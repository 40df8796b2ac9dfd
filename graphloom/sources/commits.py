"""Tables of keyed rows that several writers change at once, by an optimistic log of commits.

A table is a folder of the shared store: `data/` holds what writers wrote, `log/` one small file a commit, which
names a data folder and gets the next free number.  A file of the log is made only if it isn't there, so of two
writers that saw the same version one commits and the other looks again: it works out its change on the new version
and retries.  Readers take the files of the log in order and see whole commits alone.  A key's row is that of its
last commit."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.sources.shared import written

#: Column with the number of the commit that a row came with.
COMMIT = "__commit"
#: Times that a change is worked out anew because others were first.
RETRIES = 50


class Conflict(RuntimeError):
    """Others kept changing the table first."""


class Folder:
    """Small files in a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.conf)

    def names(self, sub: str) -> list[str]:
        path, store = self._path(sub)
        return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []

    def read(self, name: str) -> str:
        path, store = self._path(name)
        stream = store.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file with this text unless there is one of that name: whole or not at all, and for one caller only."""
        path, store = self._path(name)
        store.mkdirs(path.getParent())
        draft = f"draft-{uuid.uuid4().hex}"
        draft_path, _ = self._path(draft)
        stream = store.create(draft_path, False)
        stream.write(text.encode())
        stream.close()
        try:
            if store.getScheme() == "file":
                # a hard link is refused if its name is taken; this store's own rename isn't
                os.link(draft_path.toUri().getPath(), path.toUri().getPath())
                return True
            return bool(store.rename(draft_path, path))
        except FileExistsError:
            return False
        finally:
            store.delete(draft_path, False)

    def delete(self, name: str) -> None:
        path, store = self._path(name)
        store.delete(path, True)


class CommittedTable:
    """A table of rows with one column as key.  Null keys are a key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.files = Folder(spark, folder)

    def version(self) -> int:
        """Number of the last commit, 0 for a table without one."""
        names = self.files.names("log")
        return int(names[-1].removesuffix(".json")) if names else 0

    def parts(self, version: int) -> list[str]:
        """Data folders that make up a version: those of its commits since the last that replaced all before."""
        out: list[str] = []
        for n in range(version, 0, -1):
            commit = json.loads(self.files.read(f"log/{n:012d}.json"))
            out.append(f"{self.folder}/{commit['data']}")
            if commit["replaces"]:
                break
        return out

    def history(self, version: int | None = None) -> DataFrame:
        """All rows of a version with the numbers of their commits."""
        shape = StructType([*self.schema.fields, StructField(COMMIT, LongType())])
        parts = self.parts(self.version() if version is None else version)
        return self.spark.read.schema(shape).parquet(*parts) if parts else self.spark.createDataFrame([], shape)

    def read(self, version: int | None = None) -> DataFrame:
        """The last row of each key."""
        rows = self.history(version).groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*self.schema.names), COMMIT).alias("__row"))
        return rows.select("__row.*")

    def change(self, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """Work out a change on the current rows and commit it, again and again until no other writer was first.

        build(current) gives the rows to add, one a key, and what to return; both may read current, and both are
        written before the commit, so what is returned is what was decided on the version that was changed."""
        for _ in range(RETRIES):
            version = self.version()
            rows, told = build(self.read(version))
            told = written(told)
            if self._commit(version, rows, replaces=False):
                return told
        raise Conflict(f"{self.folder}: {RETRIES} times others were first")

    def _commit(self, version: int, rows: DataFrame, replaces: bool) -> bool:
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, F.lit(version + 1).cast("long").alias(COMMIT)).write.parquet(f"{self.folder}/{name}")
        if self.files.create(f"log/{version + 1:012d}.json", json.dumps({"data": name, "replaces": replaces})):
            return True
        self.files.delete(name)
        return False

    def compact(self) -> bool:
        """Write the last row of each key as one commit in place of all before; False if others were first."""
        version = self.version()
        return self._commit(version, self.read(version), replaces=True)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a partial aggregate."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def insert_absent(table: CommittedTable, rows: DataFrame, order: str) -> DataFrame:
    """Add the first of rows for each key that the table lacks, and return what was added."""
    first = first_of(rows.select(*table.schema.names), table.key, order)

    def build(current: DataFrame):
        have = current.select(F.col(table.key).alias("__have"))
        new = first.join(have, F.col(table.key).eqNullSafe(F.col("__have")), "left_anti")
        return new, new

    return table.change(build)


def compare_and_set(table: CommittedTable, updates: DataFrame, order: str, expected: dict[str, Column], changes: dict[str, Column]) -> DataFrame:
    """updates with outcome: `updated` where the key's row is as expected, `stale` where it isn't, `missing` where
    there is none.

    updates holds the table's key and an order.  expected: for columns of the table, what they must be (null is
    null); changes: what columns become.  Both are expressions over the row, as `row.x`, and the update, as `u.x`;
    a column that isn't named keeps its value.  Of a key's updates the first in order that meets its expectation is
    made; the others find its row changed and are stale."""
    names = table.schema.names

    def build(current: DataFrame):
        both = updates.select(F.struct(*updates.columns).alias("u")).join(current.select(F.struct(*names).alias("row")), F.col(f"u.{table.key}").eqNullSafe(F.col(f"row.{table.key}")), "left")
        good = F.lit(True)
        for column, value in expected.items():
            good = good & F.col(f"row.{column}").eqNullSafe(value)
        both = both.withColumn("__good", good & F.col("row").isNotNull())
        firsts = both.filter("__good").groupBy(F.col(f"u.{table.key}").alias("__key")).agg(F.min(f"u.{order}").alias("__first"))
        both = both.join(firsts, F.col("__key").eqNullSafe(F.col(f"u.{table.key}")), "left")
        made = F.col("__good") & (F.col(f"u.{order}") == F.col("__first"))
        outcome = F.when(F.col("row").isNull(), "missing").when(made, "updated").otherwise("stale")
        told = both.withColumn("outcome", outcome)
        new = told.filter("outcome = 'updated'").select(*[changes.get(n, F.col(f"row.{n}")).cast(table.schema[n].dataType).alias(n) for n in names])
        return new, told.select("u.*", "outcome")

    return table.change(build)


def set_once(table: CommittedTable, updates: DataFrame, order: str, column: str) -> DataFrame:
    """updates with outcome, as compare_and_set: a column that is null takes the first update's value for good."""
    return compare_and_set(table, updates, order, {column: F.lit(None)}, {column: F.col(f"u.{column}")})
