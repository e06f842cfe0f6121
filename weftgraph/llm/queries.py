"""Queries of the operators in this package, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.groups import linked_groups
from weftgraph.llm.heavy_hitters import frequent_items
from weftgraph.llm.leaks import leaked_items, removal_spans
from weftgraph.llm.skeleton import visually_equal_groups, visually_equal_pairs
from weftgraph.llm.tokens import token_ids
from weftgraph.session import table

P1_SUPPORT = "0.002"
P7_WORDS = 12


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(table(spark, d, "matrix_element"), "col", P1_SUPPORT).select(F.col("item").alias("col"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    out = frequent_items(table(spark, d, "matrix_element"), "col", P1_SUPPORT)
    return out.select(F.col("item").alias("col"), "n", F.expr("lower <= n AND n <= upper").alias("within_bounds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(spark, table(spark, d, "vertices"), table(spark, d, "match_pair"))


def p5_spread(spark: SparkSession, d: str) -> DataFrame:
    """p5_found with the rows of hot vertices spread whatever the tables' size."""
    return linked_groups(spark, table(spark, d, "vertices"), table(spark, d, "match_pair"), task_rows=0)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(spark, table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark, table(spark, d, "documents"), table(spark, d, "eval_item"), P7_WORDS)


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return removal_spans(spark, table(spark, d, "documents"), table(spark, d, "eval_item"), P7_WORDS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return visually_equal_pairs(table(spark, d, "documents")).toDF("doc_id_a", "doc_id_b")


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each document of a group with different texts, and the smallest id of its group."""
    g = visually_equal_groups(table(spark, d, "documents"))
    first = g.groupBy("s0", "s1").agg(F.min("id").alias("group_id"))
    return g.join(first, ["s0", "s1"]).select(F.col("id").alias("doc_id"), "group_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p5_found, p5_spread, p6_ids, p7_found, p7_spans, p8_found, p8_groups)}

_FREQUENT = """
    FROM matrix_element WHERE col IS NOT NULL GROUP BY col
    HAVING count(*) * 500 >= (SELECT count(*) FROM matrix_element WHERE col IS NOT NULL)
"""

ORACLE_SQL = {
    "p1_found": f"SELECT col {_FREQUENT}",
    "p1_counts": f"SELECT col, count(*) AS n, true AS within_bounds {_FREQUENT}",
    "p5_found": """
        WITH RECURSIVE e AS (
            SELECT row AS a, col AS b FROM match_pair WHERE row <> col UNION SELECT col, row FROM match_pair WHERE row <> col),
        k(v, low) USING KEY (v) AS (
            SELECT v, v FROM (SELECT id AS v FROM vertices UNION SELECT a FROM e)
            UNION SELECT e.b, min(k.low) FROM k JOIN e ON e.a = k.v JOIN recurring.k r ON r.v = e.b WHERE r.low > k.low GROUP BY e.b)
        SELECT v AS id, low AS group_id FROM k WHERE v IN (SELECT id FROM vertices)""",
}
ORACLE_SQL["p5_spread"] = ORACLE_SQL["p5_found"]
