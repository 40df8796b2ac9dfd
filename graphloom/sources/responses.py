"""A provider's responses made of the driver's tables: a repository whose folders are the parts' brands and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The root's name is that of this text.
ROOT = "root"
#: Kinds of entries by size, in Spark's SQL and the checks' alike: links, submodules, executables and plain files.
MODE = "CASE WHEN p_size % 7 = 0 THEN '120000' WHEN p_size % 11 = 0 THEN '160000' WHEN p_size % 2 = 0 THEN '100755' ELSE '100644' END"
TYPE = "CASE WHEN p_size % 7 <> 0 AND p_size % 11 = 0 THEN 'commit' ELSE 'blob' END"
#: Brands whose whole listing the provider cuts off.
CUT = "p_brand LIKE '%3'"


def _listing(rows: DataFrame, owner: str, folder: str) -> DataFrame:
    """Responses name, body: one for each owner of rows(owner, path, mode, type, sha, size, cut)."""
    entry = F.struct("path", "mode", "type", "sha", "size")
    tree = rows.groupBy(owner).agg(F.collect_list(F.when(~F.col("cut"), entry)).alias("tree"), F.first("cut").alias("truncated"))
    sha = F.sha1(F.col(owner))
    return tree.select(F.concat(F.lit(f"{folder}/"), sha).alias("name"), F.to_json(F.struct(sha.alias("sha"), "tree", "truncated")).alias("body"))


def tree_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's whole listing and some brands' are cut off, so that the scan goes down one level, or two."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    none, no = F.lit(None).cast("long"), F.lit(False)
    file = F.concat(F.col("p_partkey").cast("string"), F.lit(".js"))
    both = F.concat("p_brand", F.lit("+"), "p_type")
    leaf = {"mode": F.expr(MODE), "type": F.expr(TYPE), "sha": F.sha1(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))), "size": F.length("p_name").cast("long")}
    folder = {"mode": F.lit("040000"), "type": F.lit("tree"), "size": none}

    def rows(owner: Column, path: Column, fields: dict, cut: Column = no, sha: Column | None = None) -> DataFrame:
        fields = fields if sha is None else {**fields, "sha": F.sha1(sha)}
        return p.select(owner.alias("owner"), path.alias("path"), cut.alias("cut"), *[c.alias(n) for n, c in fields.items()])

    root, brand, kind = F.lit(ROOT), F.col("p_brand"), F.col("p_type")
    level = _listing(rows(root, brand, folder, sha=brand).distinct(), "owner", "trees").unionByName(_listing(rows(brand, kind, folder, sha=both).distinct(), "owner", "trees"))
    whole = rows(brand, kind, folder, F.expr(CUT), both).distinct().unionByName(rows(brand, F.concat(kind, F.lit("/"), file), leaf, F.expr(CUT)))
    deep = _listing(whole, "owner", "recursive").unionByName(_listing(rows(both, file, leaf), "owner", "recursive"))
    return level.unionByName(deep).unionByName(_listing(rows(root, brand, folder, F.lit(True), brand).distinct(), "owner", "recursive"))


#: Names of the parts' texts.
BLOB = "sha1(p_name || '#' || CAST(p_partkey AS STRING))"


def blob_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as blobs: in base64, with and without line breaks, and as text; some under another name, of another
    size, in another encoding or broken, and some not there at all."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 9
    coded = F.base64(F.col("p_name").cast("binary"))
    broken = F.concat(F.substring(coded, 1, 8), F.lit("\n"), F.substring(coded, 9, 10_000))
    body = F.struct(
        F.when(k == 3, F.sha1(F.lit("x"))).otherwise(F.expr(BLOB)).alias("sha"),
        (F.octet_length("p_name") + F.when(k == 4, 1).when(k == 8, -10_000).otherwise(0)).alias("size"),
        F.when(k == 2, "utf-8").when(k == 5, "latin-1").otherwise("base64").alias("encoding"),
        F.when(k == 2, F.col("p_name")).when(k == 1, broken).when(k == 6, F.concat(F.lit("*"), coded)).otherwise(coded).alias("content"),
    )
    return p.filter(k != 7).select(F.concat(F.lit("blobs/"), F.expr(BLOB)).alias("name"), F.to_json(body).alias("body"))
