"""A file tree in the order in which it is shown: folders first, by name, each before what is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranks import RANGE_ROWS, RankIndex


def tree_nodes(files: DataFrame) -> DataFrame:
    """path, name, kind, depth, files, nodes of every file of files(path) and every folder above one: how many files are
    in it, and how many files and folders.  Empty parts of a path don't count; a name that is a file's and a folder's is a
    folder; repeated paths count once."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    whole = files.select(parts.alias("parts")).filter(F.size("parts") > 0).distinct()
    steps = whole.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    at = steps.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), "depth", (F.col("depth") == F.size("parts")).cast("int").alias("is_file"))
    nodes = at.groupBy("path", "depth").agg(F.min("is_file").alias("is_file"))
    up = nodes.filter("depth > 1").select(F.split("path", "/").alias("parts"), "is_file")
    up = up.select("is_file", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))).alias("path"))
    inside = up.groupBy("path").agg(F.sum("is_file").alias("files"), F.count(F.lit(1)).alias("nodes"))
    none = F.lit(0).cast("long")
    kind = F.when(F.col("is_file") == 1, "file").otherwise("folder")
    out = nodes.join(inside, "path", "left")
    return out.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), kind.alias("kind"), "depth", F.when(kind == "file", 1).otherwise(F.coalesce("files", none)).cast("long").alias("files"), F.coalesce("nodes", none).alias("nodes"))


def ordered_tree(files: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """tree_nodes with place and last: the place of each in the order shown, from 0, and that of the last thing in it, so
    that what is in a folder has the places between.  One sort by ranges gives all of it; names by code point."""
    nodes = tree_nodes(files)
    parts = F.split("path", "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.col("depth") - 1), lambda x: F.concat(F.lit("0"), x))
    own = F.concat(F.when(F.col("kind") == "folder", "0").otherwise("1"), "name")
    index = RankIndex(nodes, [F.concat(folders, F.array(own))], range_rows)
    return index.page().withColumnRenamed("pos", "place").withColumn("last", F.col("place") + F.col("nodes"))


def matches(files: DataFrame, text: str) -> DataFrame:
    """One row: how many different files' paths hold a text, whatever its case."""
    return files.select("path").distinct().agg(F.count_if(F.lower("path").contains(text.lower())).alias("matches"), F.count(F.lit(1)).alias("files"))
