"""Snapshots of folders by Spark's binary file reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import contracts as C
from graphloom.operators.extract import admissible_bytes
from graphloom.sources.shared import written


def folder_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, content and sha of every file in a folder and those below; Spark's reader
    leaves empty files out.  Content is read only where a query asks for it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    path = F.expr(f"substring(path, locate('{root}/', path) + {len(root) + 1})")
    blob = F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string"), F.lit("\0")), "UTF-8"), F.col("content"))
    return raw.select(path.alias("path"), F.col("length").alias("size"), "content", F.sha1(blob).alias("sha"))


def tree_entries(tree: DataFrame) -> DataFrame:
    """Entries of a tree(path, mode, type, sha, size) with the kind that a manifest knows and whether they are
    well formed; trees themselves are no entries."""
    kind = C.classify_entry(F.col("mode"), F.col("type"))
    ok = kind.isNotNull() & X.safe_path(F.col("path")) & F.coalesce(F.col("sha").rlike(C.SHA1), F.lit(False))
    return tree.withColumn("kind", kind).withColumn("valid", ok).filter(F.coalesce(kind != "tree", F.lit(True)))


def joined_tree(subtrees: DataFrame, root: str, max_depth: int = 64) -> DataFrame:
    """path, mode, type, sha, size of everything below a root, from subtrees(tree, name, mode, type, sha, size) that each
    list one level: names are joined to the paths of the trees that hold them, level by level.  Each level is
    written once, so none is worked out again for those below it."""
    spark = subtrees.sparkSession
    level = spark.createDataFrame([(root, "")], "tree string, prefix string")
    out = None
    for _ in range(max_depth):
        here = written(level.join(subtrees, "tree").withColumn("path", F.concat("prefix", "name")))
        part = here.select("path", "mode", "type", "sha", "size")
        out = part if out is None else out.unionByName(part)
        level = here.filter("type = 'tree'").select(F.col("sha").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return out
    raise ValueError("the tree is deeper than its bound")


def provider_identity(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """entries(path, sha, size) against the blobs(sha, size, content) that came for them: reason is null where a
    blob is the one that was asked for, small enough and text."""
    b = blobs.select(F.col("path"), F.col("sha").alias("b_sha"), F.col("size").alias("b_size"), "content")
    j = entries.join(b, "path", "left")
    reason = (
        F.when(~(F.col("sha").eqNullSafe(F.col("b_sha")) & F.col("size").eqNullSafe(F.col("b_size"))), "provider-identity-mismatch")
        .when(F.octet_length("content") > C.FILE_BYTES, "file-size-limit")
        .when(~admissible_bytes(F.col("content")), "binary-or-invalid-utf8")
    )
    return j.select("path", reason.alias("reason"))
