"""Graphs and arrays derived from the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.session import table


def copurchase(spark: SparkSession, d: str) -> Graph:
    """Parts that follow each other in an order; the weight is the smallest quantity."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").cast("bigint").alias("w"))
    e = e.filter("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    return Graph.of(table(spark, d, "part").select(F.col("p_partkey").alias("id")), e)


def event_chains(spark: SparkSession, d: str) -> Graph:
    """Each user's events in order of time: long chains."""
    ev = table(spark, d, "events")
    e = ev.select(F.col("event_id").alias("src"), F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"))
    return Graph.of(ev.select(F.col("event_id").alias("id")), e.filter("dst IS NOT NULL"))


def tree(spark: SparkSession, d: str) -> Graph:
    """region > nation > customer > orders, with ids from 0, 100, 1000 and 10000000 on."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    v = region.select(F.col("r_regionkey").cast("bigint").alias("id"))
    v = v.union(nation.select(F.col("n_nationkey").cast("bigint") + 100)).union(customer.select(F.col("c_custkey") + 1000)).union(orders.select(F.col("o_orderkey") + 10000000))
    e = nation.select(F.col("n_regionkey").cast("bigint").alias("src"), (F.col("n_nationkey").cast("bigint") + 100).alias("dst"))
    e = e.union(customer.select(F.col("c_nationkey").cast("bigint") + 100, F.col("c_custkey") + 1000)).union(orders.select(F.col("o_custkey") + 1000, F.col("o_orderkey") + 10000000))
    return Graph.of(v, e)


def bipartite(spark: SparkSession, d: str) -> Graph:
    """Suppliers (ids below 0: -1 - key) and the parts they deliver."""
    e = table(spark, d, "lineitem").select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    v = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id")).union(table(spark, d, "part").select("p_partkey"))
    return Graph.of(v, e)


def hub(spark: SparkSession, d: str) -> Graph:
    """Orders (1 + key) and customers (-1 - key), linked both ways, and vertex 0, from
    which a third of all edges lead, one to each order."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("o"), (-1 - F.col("o_custkey")).alias("c"))
    e = o.select(F.lit(0).cast("bigint").alias("src"), F.col("o").alias("dst"), (F.col("o") % 7 + 1).alias("w"))
    e = e.union(o.select("o", "c", F.lit(2))).union(o.select("c", "o", F.lit(1)))
    v = table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("id")).union(o.select("o")).union(spark.range(1))
    return Graph.of(v, e)


def part_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Sparse matrix part x supplier of quantities, summed."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("value"))


def array_a(spark: SparkSession, d: str) -> DataFrame:
    """(pos, key, val): parts by number, with their size; val is (7 * number) mod 101."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("key"), (F.col("p_partkey") * 7 % 101).alias("val"))


def array_b(spark: SparkSession, d: str) -> DataFrame:
    """(pos, key, val): customers by number, with their nation; val is (5 * number) mod 97."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("bigint").alias("key"), (F.col("c_custkey") * 5 % 97).alias("val"))


def array_o(spark: SparkSession, d: str) -> DataFrame:
    """(pos, key, val): orders by number, with their customer; val is (11 * number) mod 103."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 11 % 103).alias("val"))


CO = """g AS (
    SELECT src, dst, min(w) AS w FROM (
        SELECT l_partkey AS src, CAST(l_quantity AS BIGINT) AS w,
            lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst
        FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
CO_BOTH = CO + ", h AS (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g)"
EV = "g AS (SELECT * FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
TREE = """v AS (
    SELECT CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT n_nationkey + 100 FROM nation
    UNION ALL SELECT c_custkey + 1000 FROM customer UNION ALL SELECT o_orderkey + 10000000 FROM orders),
g AS (
    SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey + 100 AS BIGINT) AS dst FROM nation
    UNION ALL SELECT c_nationkey + 100, c_custkey + 1000 FROM customer UNION ALL SELECT o_custkey + 1000, o_orderkey + 10000000 FROM orders)"""
BIP = """v AS (SELECT -1 - s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey FROM part),
g AS (SELECT DISTINCT -1 - l_suppkey AS src, l_partkey AS dst FROM lineitem)"""
HUB = """v AS (SELECT -1 - c_custkey AS id FROM customer UNION ALL SELECT o_orderkey + 1 FROM orders UNION ALL SELECT 0),
g AS (
    SELECT 0::BIGINT AS src, o_orderkey + 1 AS dst, (o_orderkey + 1) % 7 + 1 AS w FROM orders
    UNION ALL SELECT o_orderkey + 1, -1 - o_custkey, 2 FROM orders UNION ALL SELECT -1 - o_custkey, o_orderkey + 1, 1 FROM orders)"""
MATRIX = "m AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
A = "a AS (SELECT p_partkey AS pos, CAST(p_size AS BIGINT) AS key, p_partkey * 7 % 101 AS val FROM part)"
B = "b AS (SELECT c_custkey AS pos, CAST(c_nationkey AS BIGINT) AS key, c_custkey * 5 % 97 AS val FROM customer)"
O = "o AS (SELECT o_orderkey AS pos, o_custkey AS key, o_orderkey * 11 % 103 AS val FROM orders)"  # noqa: E741
