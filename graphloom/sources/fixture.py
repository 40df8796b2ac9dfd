"""The driver's tables projected into the code-graph model (nodes, edges)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = ("id", "kind", "name", "path", "symbol_kind", "exported", "method")
EDGE = ("src", "dst", "kind")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, **columns) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None).cast("boolean" if c == "exported" else "string")).alias(c) for c in NODE])


def _edge(df: DataFrame, src, dst, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))


def ident(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the path of their file."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    path = F.concat(F.lit("geo/"), "r_name", F.lit("/"), "n_name", F.lit(".ts"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", path.alias("path"))


def part_path():
    return F.concat(F.lit("catalog/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".js"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    home = places(spark, sf_dir)
    region = _node(t("region"), id=ident("package:", "r_regionkey"), kind=F.lit("package"), name=F.col("r_name"))
    nation = _node(home, id=ident("file:nation/", "n_nationkey"), kind=F.lit("file"), name=F.col("n_name"), path=F.col("path"))
    customer = t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    customer = _node(customer, id=ident("symbol:customer/", "c_custkey"), kind=F.lit("symbol"), name=F.col("c_name"), path=F.col("path"), symbol_kind=F.col("c_mktsegment"), exported=F.col("c_acctbal") > 0)
    supplier = t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    supplier = _node(supplier, id=ident("schema:supplier/", "s_suppkey"), kind=F.lit("schema"), name=F.col("s_name"), path=F.col("path"))
    part = _node(t("part"), id=ident("file:part/", "p_partkey"), kind=F.lit("file"), name=F.col("p_name"), path=part_path())
    order_path = F.concat(F.lit("orders/"), F.year("o_orderdate").cast("string"), F.lit(".ts"))
    order_name = F.concat("o_orderpriority", F.lit(" /orders/"), F.col("o_orderkey").cast("string"))
    order = _node(t("orders"), id=ident("route:order/", "o_orderkey"), kind=F.lit("route"), name=order_name, path=order_path, method=F.col("o_orderstatus"))
    return region.unionByName(nation).unionByName(customer).unionByName(supplier).unionByName(part).unionByName(order)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = [
        _edge(t("nation"), ident("file:nation/", "n_nationkey"), ident("package:", "n_regionkey"), "depends-on"),
        _edge(t("customer"), ident("file:nation/", "c_nationkey"), ident("symbol:customer/", "c_custkey"), "declares"),
        _edge(t("orders"), ident("symbol:customer/", "o_custkey"), ident("route:order/", "o_orderkey"), "handles-route"),
        _edge(line.select("l_orderkey", "l_partkey").distinct(), ident("route:order/", "l_orderkey"), ident("file:part/", "l_partkey"), "references"),
        _edge(line.select("l_partkey", "l_suppkey").distinct(), ident("file:part/", "l_partkey"), ident("schema:supplier/", "l_suppkey"), "imports"),
        _edge(t("supplier"), ident("schema:supplier/", "s_suppkey"), ident("file:nation/", "s_nationkey"), "contains"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same projection for the SQL checks.
SQL = """
WITH RECURSIVE home AS (SELECT n_nationkey, n_name, n_regionkey, 'geo/' || r_name || '/' || n_name || '.ts' AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
fx_nodes AS (
  SELECT 'package:' || r_regionkey AS id, 'package' AS kind, r_name AS name, NULL::VARCHAR AS path, NULL::VARCHAR AS symbol_kind, NULL::BOOLEAN AS exported, NULL::VARCHAR AS method FROM region
  UNION ALL SELECT 'file:nation/' || n_nationkey, 'file', n_name, path, NULL, NULL, NULL FROM home
  UNION ALL SELECT 'symbol:customer/' || c_custkey, 'symbol', c_name, path, c_mktsegment, c_acctbal > 0, NULL FROM customer JOIN home ON c_nationkey = n_nationkey
  UNION ALL SELECT 'schema:supplier/' || s_suppkey, 'schema', s_name, path, NULL, NULL, NULL FROM supplier JOIN home ON s_nationkey = n_nationkey
  UNION ALL SELECT 'file:part/' || p_partkey, 'file', p_name, 'catalog/' || p_brand || '/' || p_type || '/' || p_partkey || '.js', NULL, NULL, NULL FROM part
  UNION ALL SELECT 'route:order/' || o_orderkey, 'route', o_orderpriority || ' /orders/' || o_orderkey, 'orders/' || year(o_orderdate) || '.ts', NULL, NULL, o_orderstatus FROM orders),
fx_edges AS (
  SELECT 'file:nation/' || n_nationkey AS src, 'package:' || n_regionkey AS dst, 'depends-on' AS kind FROM nation
  UNION ALL SELECT 'file:nation/' || c_nationkey, 'symbol:customer/' || c_custkey, 'declares' FROM customer
  UNION ALL SELECT 'symbol:customer/' || o_custkey, 'route:order/' || o_orderkey, 'handles-route' FROM orders
  UNION ALL SELECT DISTINCT 'route:order/' || l_orderkey, 'file:part/' || l_partkey, 'references' FROM lineitem
  UNION ALL SELECT DISTINCT 'file:part/' || l_partkey, 'schema:supplier/' || l_suppkey, 'imports' FROM lineitem
  UNION ALL SELECT 'schema:supplier/' || s_suppkey, 'file:nation/' || s_nationkey, 'contains' FROM supplier)"""
