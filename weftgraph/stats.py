"""Degrees, offsets and other figures of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators.scan import scan


def degrees(graph: Graph, directed: bool = True) -> DataFrame:
    """(id, degree): edges that leave each vertex; those that enter it too if not directed. Isolated vertices have 0."""
    e = graph.view(directed).edges
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def in_degrees(graph: Graph) -> DataFrame:
    return degrees(graph.transpose())


def degree_histogram(graph: Graph) -> DataFrame:
    """(bucket, n, percent): vertices by floor(log2(out-degree)); bucket -1 holds degree 0."""
    bucket = F.when(F.col("degree") == 0, -1).otherwise(F.floor(F.log2("degree"))).cast("int")
    h = degrees(graph).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = graph.vertices.agg(F.count("*").alias("t"))
    return h.select("bucket", "n", (F.col("n") * 100.0 / total.scalar()).alias("percent"))


def max_degree(graph: Graph) -> DataFrame:
    """(id, degree): the vertex of largest out-degree, of ties the smallest id; no row for an empty graph."""
    best = degrees(graph).agg(F.max(F.struct("degree", (-F.col("id")).alias("down"))).alias("m"))
    return best.select((-F.col("m.down")).alias("id"), F.col("m.degree").alias("degree")).filter("id IS NOT NULL")


def traversed_edges(graph: Graph, levels: DataFrame) -> DataFrame:
    """(traversed): out-degrees summed over the vertices with a level of at least 0."""
    reached = levels.filter("level >= 0").select("id")
    return graph.edges.join(reached, graph.edges.src == reached.id, "left_semi").agg(F.count("*").alias("traversed"))


def component_count(labels: DataFrame, column: str = "component") -> DataFrame:
    return labels.agg(F.countDistinct(column).alias("components"))


def adjacency(graph: Graph) -> DataFrame:
    """(id, out, into): sorted neighbour lists of each vertex, empty for none.

    One row holds all neighbours of a vertex, as the form demands; it is a dump for graphs
    whose largest degree fits a row, not a step of any algorithm here."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("out"))
    into = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("into"))
    none = F.array().cast("array<bigint>")
    return graph.vertices.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("out", none).alias("out"), F.coalesce("into", none).alias("into"))


def offsets(graph: Graph) -> DataFrame:
    """(id, offset): position of the first edge of each vertex when edges are sorted by source."""
    return scan(degrees(graph), "id", "degree", inclusive=False, to="offset").select("id", "offset")


def indices(offset_rows: DataFrame, total: int | None = None) -> DataFrame:
    """(pos, id): the owner of each edge position, from rows of (id, offset, degree)."""
    from weftgraph.operators.order import repeated

    return repeated(offset_rows, "degree", "_k", "id").select((F.col("offset") + F.col("_k")).alias("pos"), "id")


def edge_ids(graph: Graph) -> DataFrame:
    """(src, dst, w, eid): edges numbered in the order (src, dst, w)."""
    from weftgraph.operators.order import number_rows

    return number_rows(graph.edges, ["src", "dst", "w"], "eid")
