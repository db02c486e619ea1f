"""A property graph over the star schema of the test tables: regions contain nations, these customers and suppliers, customers
contain orders; orders import parts and call suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _node(rows: DataFrame, node_id: Column, kind: str, label: Column, repository: Column, path: Column) -> DataFrame:
    out = rows.select(node_id.alias("id"), F.lit(kind).alias("type"), label.alias("label"), repository.alias("repositoryId"), path.alias("filePath"))
    return out.withColumn("metadataJson", F.concat(F.lit('{"path":"'), "filePath", F.lit('"}')))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_stored: dict[tuple[str, str], tuple[tuple, DataFrame, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables were written, and how long they are."""
    out = []
    for name in _TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        s = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((s.getModificationTime(), s.getLen()))
    return tuple(out)


def stored_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph's nodes and edges as tables, which are derived once for a session and a directory, and again when its tables have
    changed, and then read: filters on type, repository and path reach the scan."""
    from graphloam.plans.durable import Tables

    key = spark.sparkContext.applicationId, sf_dir
    state = _state(spark, sf_dir)
    if key not in _stored or _stored[key][0] != state:
        tables = Tables(spark)
        _stored[key] = state, tables.write(star_nodes(spark, sf_dir)), tables.write(star_edges(spark, sf_dir))
    return _stored[key][1:]


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: _table(spark, sf_dir, n) for n in _TABLES}
    region_of = t["nation"].select("n_nationkey", "n_regionkey", "n_name")
    customers = t["customer"].join(region_of, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t["supplier"].join(region_of, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].join(customers.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    # a part belongs to the last of the repositories that refer to it
    owner = t["lineitem"].select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "n_regionkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.max("n_regionkey").alias("n_regionkey"))
    parts = t["part"].join(owner, F.col("p_partkey") == F.col("l_partkey"))
    repo = _id("r", "n_regionkey")
    rows = [
        _node(t["region"], _id("r", "r_regionkey"), "repository", F.col("r_name"), _id("r", "r_regionkey"), F.lit("")),
        _node(t["nation"], _id("n", "n_nationkey"), "module", F.col("n_name"), repo, F.concat(F.lit("nations/"), "n_name")),
        _node(customers, _id("c", "c_custkey"), "file", F.col("c_name"), repo, F.concat(F.lit("customers/"), "c_mktsegment")),
        _node(suppliers, _id("s", "s_suppkey"), "service", F.col("s_name"), repo, F.concat(F.lit("suppliers/"), "n_name")),
        _node(orders, _id("o", "o_orderkey"), "class", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), repo, F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"))),
        _node(parts, _id("p", "p_partkey"), "external_dependency", F.col("p_name"), repo, F.concat(F.lit("parts/"), F.col("p_brand"))),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(rows: DataFrame, kind: str, a: Column, b: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("type"), a.alias("sourceId"), b.alias("targetId"))

    # one shuffle by order for both kinds of pairs; so many partitions that the distinct pairs of one fit into memory
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    pair = lambda kind, letter, key: F.struct(F.lit(kind).alias("type"), F.lit(letter).alias("letter"), F.col(key).alias("key"))
    pairs = line.select("l_orderkey", F.inline(F.array(pair("IMPORTS", "p", "l_partkey"), pair("CALLS", "s", "l_suppkey")))).distinct()
    out = edge(_table(spark, sf_dir, "nation"), "CONTAINS", _id("r", "n_regionkey"), _id("n", "n_nationkey"))
    out = out.unionByName(edge(_table(spark, sf_dir, "customer"), "CONTAINS", _id("n", "c_nationkey"), _id("c", "c_custkey")))
    out = out.unionByName(edge(_table(spark, sf_dir, "supplier"), "CONTAINS", _id("n", "s_nationkey"), _id("s", "s_suppkey")))
    out = out.unionByName(edge(_table(spark, sf_dir, "orders"), "CONTAINS", _id("c", "o_custkey"), _id("o", "o_orderkey")))
    out = out.unionByName(pairs.select("type", _id("o", "l_orderkey").alias("sourceId"), F.concat("letter", F.col("key").cast("string")).alias("targetId")))
    return out.select(F.concat("type", F.lit(":"), "sourceId", F.lit("->"), "targetId").alias("id"), "sourceId", "targetId", "type")


#: The same graph in SQL, as the beginning of a statement.
STAR_SQL = """WITH RECURSIVE
cus AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
sup AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ord AS (SELECT o.*, n_regionkey FROM orders o JOIN cus ON o_custkey = c_custkey),
own AS (SELECT l_partkey, max(n_regionkey) AS n_regionkey FROM lineitem JOIN ord ON l_orderkey = o_orderkey GROUP BY l_partkey),
nodes0 AS (
  SELECT 'r' || r_regionkey AS id, 'repository' AS type, r_name AS label, 'r' || r_regionkey AS "repositoryId", '' AS "filePath" FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'module', n_name, 'r' || n_regionkey, 'nations/' || n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'file', c_name, 'r' || n_regionkey, 'customers/' || c_mktsegment FROM cus
  UNION ALL SELECT 's' || s_suppkey, 'service', s_name, 'r' || n_regionkey, 'suppliers/' || n_name FROM sup
  UNION ALL SELECT 'o' || o_orderkey, 'class', 'order ' || o_orderkey, 'r' || n_regionkey, 'orders/' || o_orderkey FROM ord
  UNION ALL SELECT 'p' || p_partkey, 'external_dependency', p_name, 'r' || n_regionkey, 'parts/' || p_brand FROM part JOIN own ON p_partkey = l_partkey),
nodes AS (SELECT *, '{"path":"' || "filePath" || '"}' AS "metadataJson" FROM nodes0),
edges0 AS (
  SELECT 'CONTAINS' AS type, 'r' || n_regionkey AS "sourceId", 'n' || n_nationkey AS "targetId" FROM nation
  UNION ALL SELECT 'CONTAINS', 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'CONTAINS', 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'IMPORTS', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'CALLS', 'o' || l_orderkey, 's' || l_suppkey FROM lineitem),
edges AS (SELECT type || ':' || "sourceId" || '->' || "targetId" AS id, "sourceId", "targetId", type FROM edges0)
"""
