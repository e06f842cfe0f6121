"""Contraction of undirected graphs: the part that connected components are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.operators.hot import TASK_ROWS, spread_join
from weftgraph.session import Workspace


def simple_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b: each undirected edge once, without loops and null ends."""
    x, y = F.col(f"`{a}`").cast("bigint"), F.col(f"`{b}`").cast("bigint")
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (x != y).alias("ok")).filter("ok").select("a", "b").distinct()


def both_ends(edges: DataFrame) -> DataFrame:
    """(v, u): each edge of (a, b) from both its ends."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))
    return edges.select(F.explode(ends).alias("x")).select("x.v", "x.u")


def contract_round(ws: Workspace, edges: DataFrame, n: int, seed: int, task_rows: int = TASK_ROWS) -> tuple[tuple[DataFrame, int], DataFrame, int]:
    """((removed: v, parent; at most so many rows), the smaller graph: a, b; its edges) of a graph of ``n`` edges.

    Each vertex hooks to its neighbour of smallest random priority, if that is smaller than
    its own; pointers are doubled up to the roots; edges are drawn between roots.  Vertices
    that stay are local minima, so each round leaves about a share 1/(degree + 1) of them,
    whatever the ids.  A hub, and a root with very many children, are spread over tasks.
    """
    of = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("id"))
    hook = both_ends(edges).groupBy("v").agg(F.min(of("u")).alias("best"))
    f, rows = ws.counted(hook.select("v", F.when(F.col("best") < of("v"), F.col("best.id")).otherwise(F.col("v")).alias("parent")), "hooks")
    moved = 1
    while moved:
        up = f.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
        seen = Observation()
        jumped = spread_join(f, up, "parent", "v", rows, task_rows=task_rows).observe(seen, F.count_if(F.col("above") != F.col("parent")).alias("moved"))
        new = ws.keep(jumped.select("v", F.col("above").alias("parent")), "hooks")
        ws.drop(f)
        f, moved = new, seen.get["moved"]
    one = spread_join(edges, f.toDF("a", "ra"), "a", "b", n, task_rows=task_rows)
    both = spread_join(one, f.toDF("b", "rb"), "b", "ra", n, task_rows=task_rows)
    left, m = ws.counted(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct(), "left")
    return (f.filter("v <> parent"), rows), left, m


def contract(ws: Workspace, edges: DataFrame, n: int, task_rows: int = TASK_ROWS) -> list[tuple[DataFrame, int]]:
    """The removed vertices of all rounds, until no edge is left."""
    removed, seed = [], 0
    while n:
        out, left, n = contract_round(ws, edges, n, seed := seed + 1, task_rows)
        ws.drop(edges)
        removed.append(out)
        edges = left
    return removed


def roots_of(ws: Workspace, removed: list[tuple[DataFrame, int]], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """(v, root) of all removed vertices, from the parents of each round, last round first."""
    roots = None
    for r, rows in reversed(removed):
        if roots is None:
            roots = ws.keep(r.withColumnRenamed("parent", "root"), "roots")
            continue
        above = roots.select(F.col("v").alias("parent"), F.col("root").alias("above"))
        up = spread_join(r, above, "parent", "v", rows, "left", task_rows).select("v", F.coalesce("above", "parent").alias("root"))
        new = ws.keep(up.union(roots.select("v", "root")), "roots")
        ws.drop(roots, r)
        roots = new
    return roots


def smallest_of_group(ws: Workspace, roots: DataFrame, hot_rows: int = 1000) -> DataFrame:
    """(v, low): the smallest vertex of each vertex's group, roots included.

    Roots of more than 1/hot_rows of all rows, of which there can't be more than ``hot_rows``,
    are joined by broadcast, so a group with a third of all rows doesn't meet in one task.
    """
    low = ws.keep(roots.groupBy("root").agg(F.least(F.min("v"), F.col("root")).alias("low"), F.count("*").alias("n")), "lows")
    total = low.agg(F.sum("n").alias("t")).first()["t"] or 0
    hot = F.col("n") * hot_rows > total
    a = roots.join(F.broadcast(low.filter(hot).select("root", F.col("low").alias("hot_low"))), "root", "left")
    direct = a.filter("hot_low IS NOT NULL").select("v", F.col("hot_low").alias("low"))
    rest = a.filter("hot_low IS NULL").join(low.filter(~hot).select("root", "low"), "root").select("v", "low")
    return direct.union(rest).union(low.select(F.col("root").alias("v"), "low"))
