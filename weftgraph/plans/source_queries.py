"""Queries of generators, and of files written and read again, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators.order import number_rows
from weftgraph.plans.graphs import CO, copurchase, part_supplier
from weftgraph.session import Workspace, table
from weftgraph.sources import generators, graphs, sinks
from weftgraph.sources.text import numbered_lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_MATRIX = "SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def _add(f, sql: str | None = None):  # noqa: ANN001, ANN202
    QUERIES[f.__name__] = f
    if sql:
        ORACLE_SQL[f.__name__] = sql


def gen_grid2d(spark: SparkSession, d: str) -> DataFrame:
    return generators.grid2d(spark, 60).edges


def gen_grid3d(spark: SparkSession, d: str) -> DataFrame:
    return generators.grid3d(spark, 14).edges


def gen_random(spark: SparkSession, d: str) -> DataFrame:
    return generators.random_graph(spark, 2000, 40000, seed=1).edges


def gen_rmat(spark: SparkSession, d: str) -> DataFrame:
    return generators.rmat(spark, 2048, 40000, seed=1).edges


def gen_regular(spark: SparkSession, d: str) -> DataFrame:
    """Out-degrees of a graph in which each vertex has exactly five."""
    return generators.regularish(spark, 2000, 5, seed=1).edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def gen_sorted_array(spark: SparkSession, d: str) -> DataFrame:
    return generators.random_array(spark, 5000, 100, 130, seed=1, ordered=True)


def _file(spark: SparkSession, name: str) -> str:
    return f"{Workspace(spark).root}/{name}"


def market_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The co-purchase graph as a Matrix Market file, read again."""
    g, path = copurchase(spark, d), _file(spark, "graph.mtx")
    n = g.vertices.count()
    sinks.write_market(g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value")), n, n, path)
    return graphs.read_market(spark, path).edges


def dimacs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The graph in two spliced parts, even and odd sources, read as one."""
    g, path = copurchase(spark, d), _file(spark, "graph.gr")
    for k in range(2):
        sinks.write_dimacs(Graph(g.vertices, g.edges.filter(F.col("src") % 2 == k)), f"{path}.{k}")
    return graphs.read_dimacs(spark, path, splice=2).edges


def coordinates_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g, path = copurchase(spark, d), _file(spark, "graph.txt")
    sinks.write_coordinates(g, path)
    return graphs.read_coordinates(spark, path).edges.withColumn("w", F.col("w").cast("bigint"))


def sources_file(spark: SparkSession, d: str) -> DataFrame:
    """Starting vertices from a file that counts from 1, in its order."""
    path = _file(spark, "sources")
    table(spark, d, "nation").select((F.col("n_nationkey") * 37 % 101 + 1).cast("string").alias("line"), "n_nationkey").orderBy("n_nationkey").select("line").write.text(path)
    return spark.createDataFrame([(i, v) for i, v in enumerate(graphs.read_sources(spark, path))], "place bigint, id bigint")


def values_file(spark: SparkSession, d: str) -> DataFrame:
    """One value a line in order of id: the result sink, read again and numbered."""
    path = _file(spark, "values")
    sinks.write_values(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("level")), "level", path)
    lines = numbered_lines(spark, path).select("file", F.col("no.block").alias("block"), F.col("no.id").alias("k"), F.col("line").cast("bigint").alias("level"))
    return number_rows(lines, ["file", "block", "k"], "place").select("place", "level")


def snap_weights(spark: SparkSession, d: str) -> DataFrame:
    """Edges with random weights, and how many weights lie outside of 0 to 100."""
    w = sinks.snap_edges(part_supplier(spark, d), seed=3)[1]
    return w.agg(F.count("*").alias("edges"), F.count_if(~F.col("w").between(0, 100)).alias("outside"), (F.countDistinct("w") > 50).alias("varied"))


def _described(edges: DataFrame, n: int, again: DataFrame) -> DataFrame:
    """One row: edges, ends outside of 0..n-1, whether nearly all vertices occur as ends, and edges that a second run with the same seed makes otherwise."""
    ends = edges.select(F.col("src").alias("v")).union(edges.select("dst"))
    a = edges.agg(F.count("*").alias("edges"), F.count_if((F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n)).alias("outside"), F.count_if(F.col("w") != 1).alias("weighted"))
    b = ends.agg((F.countDistinct("v") > n // 2).alias("spread"))
    unlike = edges.exceptAll(again).agg(F.count("*").alias("unlike"))
    return a.select("*", b.scalar().alias("spread"), unlike.scalar().alias("unlike"))


def gen_random_properties(spark: SparkSession, d: str) -> DataFrame:
    make = lambda: generators.random_graph(spark, 2000, 40000, seed=1).edges
    return _described(make(), 2000, make())


def gen_rmat_properties(spark: SparkSession, d: str) -> DataFrame:
    make = lambda: generators.rmat(spark, 2048, 40000, seed=1).edges
    return _described(make(), 2048, make())


def gen_rmat_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """Edges in each quadrant as a share of the whole, in steps of 5 %: 0.45, 0.15, 0.15, 0.25 by the defaults."""
    e = generators.rmat(spark, 2048, 400000, seed=1).edges
    q = e.groupBy((F.floor(F.col("src") / 1024)).cast("int").alias("down"), (F.floor(F.col("dst") / 1024)).cast("int").alias("right")).agg(F.count("*").alias("n"))
    return q.select("down", "right", F.round(F.round(F.col("n") / 400000 / 0.05) * 0.05, 2).alias("share"))


def gen_sorted_properties(spark: SparkSession, d: str) -> DataFrame:
    """A sorted array against the same unsorted: rows, places, falls from one place to the next, values it has and the other has not."""
    a = generators.random_array(spark, 5000, 100, 130, seed=1, ordered=True)
    nxt = a.select((F.col("pos") - 1).alias("pos"), F.col("val").alias("next"))
    falls = a.join(nxt, "pos").agg(F.count_if(F.col("next") < F.col("val")).alias("falls"))
    shape = a.agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("val").alias("low"), F.max("val").alias("high"))
    other = generators.random_array(spark, 5000, 100, 130, seed=1)
    unlike = a.select("val").exceptAll(other.select("val")).agg(F.count("*").alias("unlike"))
    return shape.select("*", falls.scalar().alias("falls"), unlike.scalar().alias("unlike"))


def random_sources_properties(spark: SparkSession, d: str) -> DataFrame:
    """Draws, those that have no out-edge, and draws that the same seed makes otherwise."""
    g = copurchase(spark, d)
    a, b = (graphs.random_sources(g, 100, seed=1) for _ in range(2))
    drawn = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "k bigint, src bigint, again bigint")
    some = g.edges.select("src").distinct()
    without = drawn.join(some, "src", "left_anti").agg(F.count("*").alias("without_edges"))
    return drawn.agg(F.count("*").alias("draws"), F.count_if(F.col("src") != F.col("again")).alias("unlike")).select("*", without.scalar().alias("without_edges"))


def gen_regular_ends(spark: SparkSession, d: str) -> DataFrame:
    e = generators.regularish(spark, 2000, 5, seed=1).edges
    return _described(e, 2000, generators.regularish(spark, 2000, 5, seed=1).edges)


def metis_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g, path = copurchase(spark, d).both_ways(), _file(spark, "graph.metis")
    sinks.write_metis(g, path)
    return graphs.read_metis(spark, path).edges


def matrix_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A sparse matrix as text, then as its binary form."""
    text, binary = _file(spark, "matrix.mtx"), _file(spark, "matrix")
    m = part_supplier(spark, d)
    height, width = (x + 1 for x in m.agg(F.max("row"), F.max("col")).first())
    sinks.write_market(m, height, width, text)
    sinks.store_matrix(graphs.read_matrix(spark, text)[0], binary)
    return sinks.load_matrix(spark, binary)


def snap_edges(spark: SparkSession, d: str) -> DataFrame:
    return sinks.snap_edges(part_supplier(spark, d), "symmetric")[0]


def random_sources(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in graphs.random_sources(copurchase(spark, d), 100, seed=1)], "id bigint")


def _grid_sql(width: int, dims: int) -> str:
    n = width**dims
    steps = " UNION ALL ".join(["SELECT i, i FROM v"] + [f"SELECT i, i {s} {width**k} FROM v WHERE i // {width**k} % {width} {'>' if s == '-' else '<'} {0 if s == '-' else width - 1}" for k in range(dims) for s in "-+"])
    return f"WITH v AS (SELECT range AS i FROM range({n})), e(src, dst) AS ({steps}) SELECT src, dst, 1::BIGINT AS w FROM e"


_add(gen_grid2d, _grid_sql(60, 2))
_add(gen_grid3d, _grid_sql(14, 3))
_add(gen_random)
_add(gen_rmat)
_add(gen_regular, "SELECT range AS id, 5::BIGINT AS degree FROM range(2000)")
_add(gen_sorted_array)
_PROPERTIES = "SELECT {0}::BIGINT AS edges, 0::BIGINT AS outside, 0::BIGINT AS weighted, true AS spread, 0::BIGINT AS unlike"
_add(gen_random_properties, _PROPERTIES.format(40000))
_add(gen_rmat_properties, _PROPERTIES.format(40000))
_add(gen_rmat_quadrants, "SELECT * FROM (VALUES (0, 0, 0.45::DOUBLE), (0, 1, 0.15::DOUBLE), (1, 0, 0.15::DOUBLE), (1, 1, 0.25::DOUBLE)) AS t(down, \"right\", share)")
_add(gen_regular_ends, _PROPERTIES.format(10000))
_add(gen_sorted_properties, "SELECT 5000::BIGINT AS n, 0::BIGINT AS first, 4999::BIGINT AS last, 100::BIGINT AS low, 130::BIGINT AS high, 0::BIGINT AS falls, 0::BIGINT AS unlike")
_add(random_sources_properties, "SELECT 100::BIGINT AS draws, 0::BIGINT AS unlike, 0::BIGINT AS without_edges")
_add(dimacs_round_trip, f"WITH {CO} SELECT src, dst, w FROM g")
_add(coordinates_round_trip, f"WITH {CO} SELECT src, dst, w FROM g")
_add(sources_file, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, CAST(n_nationkey * 37 % 101 AS BIGINT) AS id FROM nation")
_add(values_file, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, CAST(p_size AS BIGINT) AS level FROM part")
_add(snap_weights, f"SELECT count(*) AS edges, 0::BIGINT AS outside, true AS varied FROM ({_MATRIX})")
_add(market_round_trip, f"WITH {CO} SELECT src, dst, w FROM g")
_add(metis_round_trip, f"WITH {CO} SELECT src, dst, 1::BIGINT AS w FROM g UNION ALL SELECT dst, src, 1 FROM g")
_add(matrix_round_trip, _MATRIX)
_add(snap_edges, f"WITH m AS ({_MATRIX}) SELECT row AS src, col AS dst FROM m UNION ALL SELECT col, row FROM m")
_add(random_sources)
