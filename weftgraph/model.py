"""Graphs as plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Vertices (id) and directed edges (src, dst, w).

    Parallel edges and self-loops are kept.  Vertices come from their own table, never from
    the edges, so isolated ones exist; an edge may not name an id that ``vertices`` lacks.
    """

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        """Bring columns to their types; null ids and edges with a null end are left out, a null or missing weight is 1."""
        w = F.coalesce(F.col("w"), F.lit(1)) if "w" in edges.columns else F.lit(1).cast("bigint")
        ends = [F.col(c).cast("bigint").alias(c) for c in ("src", "dst")]
        return cls(
            vertices.select(F.col("id").cast("bigint").alias("id")).filter("id IS NOT NULL").distinct(),
            edges.select(*ends, w.alias("w")).filter("src IS NOT NULL AND dst IS NOT NULL"),
        )

    def transpose(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def both_ways(self) -> Graph:
        """Each edge in both directions; self-loops and edges listed both ways count twice."""
        return Graph(self.vertices, self.edges.unionByName(self.transpose().edges))

    def view(self, directed: bool) -> Graph:
        return self if directed else self.both_ways()
