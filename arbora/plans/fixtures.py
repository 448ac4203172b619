"""Domain tables derived from the order tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """SELECT neuron, node_id,
  CAST(CASE WHEN node_id = 1 THEN -1 WHEN node_id % 3 = 0 THEN FLOOR(node_id / 3) ELSE node_id - 1 END AS BIGINT) AS parent_id,
  x, y, z, radius, label
FROM (SELECT CAST(FLOOR(l_orderkey / 64) AS BIGINT) AS neuron,
  CAST(ROW_NUMBER() OVER (PARTITION BY FLOOR(l_orderkey / 64) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS node_id,
  CAST(l_extendedprice / 100.0 AS DOUBLE) AS x, CAST(l_partkey AS DOUBLE) AS y, CAST(l_suppkey * 10.0 AS DOUBLE) AS z,
  CAST(l_quantity AS DOUBLE) AS radius, l_returnflag AS label FROM lineitem) t"""

CONNECTORS = """SELECT n.neuron, CAST(FLOOR(n.neuron / 8) * 97 + n.node_id % 97 AS BIGINT) AS connector_id, n.node_id,
  CASE WHEN (n.node_id + n.neuron) % 2 = 0 THEN 'pre' ELSE 'post' END AS type, n.x, n.y, n.z
FROM nodes n WHERE n.node_id % 5 = 0"""

EDGES = """SELECT CAST(l_suppkey AS BIGINT) AS source, CAST(l_partkey AS BIGINT) AS target, COUNT(*) AS weight
FROM lineitem GROUP BY l_suppkey, l_partkey"""

VOXELS = """SELECT neuron, CAST(FLOOR(x / 50) AS BIGINT) AS i, CAST(FLOOR(y / 50) AS BIGINT) AS j,
  CAST(FLOOR(z / 50) AS BIGINT) AS k, COUNT(*) AS value FROM nodes GROUP BY 1, 2, 3, 4"""

POINTS = """SELECT neuron, node_id AS pid, (x + px) / 2 AS x, (y + py) / 2 AS y, (z + pz) / 2 AS z,
  (x - px) / len AS vx, (y - py) / len AS vy, (z - pz) / len AS vz, len AS length
FROM (SELECT c.neuron, c.node_id, c.x, c.y, c.z, p.x AS px, p.y AS py, p.z AS pz,
        SQRT((c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) + (c.z-p.z)*(c.z-p.z)) AS len
      FROM nodes c JOIN nodes p ON p.neuron = c.neuron AND p.node_id = c.parent_id) c WHERE len > 0"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONNECTORS.replace("FROM nodes n", "FROM {nodes} n"), nodes=nodes(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOXELS.replace("FROM nodes", "FROM {nodes}"), nodes=nodes(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS.replace("FROM nodes c JOIN nodes p", "FROM {nodes} c JOIN {nodes} p"), nodes=nodes(spark, sf_dir))
