"""One identifier for all records linked directly or indirectly (problem 5).

Each round removes the easy part of the graph and keeps a parent for every vertex removed:

* chains of degree-two vertices are compressed by list ranking: every side of every chain
  vertex points one step along its chain, and pointers are doubled until they reach the
  chain's end, so a chain of length L takes log2(L) joins; the chain becomes one edge;
* degree-one vertices are stripped onto their only neighbour.

What is left, the core, is solved by hooking vertices to neighbours of smaller random
priority and contracting, round by round.  Parents are then resolved in reverse order of
removal.  All steps run the same way at every size.  All state lives in tables in the shared
folder; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftgraph.algorithms.contract import both_ends, contract, roots_of, simple_edges, smallest_of_group
from weftgraph.operators.hot import SHARE, TASK_ROWS, spread_join
from weftgraph.session import Workspace


def _with_degrees(ws: Workspace, edges: DataFrame, n: int, task_rows: int) -> DataFrame:
    """(a, b, da, db, na, nb): degrees, and the smaller neighbour of each end.  A hub's edges are
    spread; which vertices are hubs is known from the degrees."""
    info = ws.keep(both_ends(edges).groupBy("v").agg(F.count("*").alias("d"), F.min("u").alias("n")), "degrees")
    hot = info.filter(F.col("d") * SHARE > n).select("v", F.ceil(F.col("d") * SHARE / F.lit(max(1, n))).cast("int").alias("_parts"))
    one = spread_join(edges, info.toDF("a", "da", "na"), "a", "b", n, task_rows=task_rows, hot=hot.withColumnRenamed("v", "a"))
    both = spread_join(one, info.toDF("b", "db", "nb"), "b", "a", n, task_rows=task_rows, hot=hot.withColumnRenamed("v", "b"))
    out = ws.keep(both.select("a", "b", "da", "db", "na", "nb"), "edges")
    ws.drop(info)
    return out


def _chain_pointers(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(v, s, ev, es, ed, low): from side s of degree-two vertex v the chain leads to vertex
    ev of degree ed, and goes on from its side es (null at the chain's end); low is the
    smallest vertex on the way.  Doubled until every pointer is at its end or on a ring."""
    at = lambda v, u, dv, du, nv, nu: edges.filter(f"{dv} = 2").select(
        F.col(v).alias("v"), F.when(F.col(nv) == F.col(u), 0).otherwise(1).alias("s"), F.col(u).alias("ev"),
        F.when(F.col(du) == 2, F.when(F.col(nu) == F.col(v), 1).otherwise(0)).alias("es"), F.col(du).alias("ed"),
        F.least(F.col(v), F.when(F.col(du) == 2, F.col(u))).alias("low"), F.when(F.col(du) != 2, 1).alias("rank"),
    )
    p, open_ = _kept(ws, at("a", "b", "da", "db", "na", "nb").union(at("b", "a", "db", "da", "nb", "na")))
    step = 1
    while open_[0]:
        q = p.select(F.col("v").alias("ev"), F.col("s").alias("es"), F.col("ev").alias("ev2"), F.col("es").alias("es2"), F.col("ed").alias("ed2"), F.col("low").alias("low2"), F.col("rank").alias("rank2"))
        jumped = p.filter("es IS NOT NULL").join(q, ["ev", "es"]).select(
            "v", "s", F.col("ev2").alias("ev"), F.col("es2").alias("es"), F.col("ed2").alias("ed"),
            F.least("low", "low2").alias("low"), (F.col("rank2") + step).alias("rank"),
        )
        before = open_
        new, open_ = _kept(ws, p.filter("es IS NULL").select(jumped.columns).union(jumped))
        ws.drop(p)
        p, step = new, step * 2
        if open_ == before:
            break  # only rings are left, and each pointer has seen its whole ring
    return p


def _kept(ws: Workspace, pointers: DataFrame) -> tuple[DataFrame, tuple]:
    """The written pointers, and of those not at an end the number and the sum of ``low``, seen while writing."""
    going, seen = F.col("es").isNotNull(), Observation()
    low = F.when(going, F.col("low").cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    out = ws.keep(pointers.observe(seen, F.count_if(going).alias("n"), F.sum(low).alias("low")), "pointers")
    return out, (seen.get["n"], seen.get["low"])


def _round(ws: Workspace, edges: DataFrame, n: int, task_rows: int) -> tuple[tuple[DataFrame, int], DataFrame, int]:
    """One round of compressing and stripping a graph of ``n`` edges: ((removed: v, parent; its
    rows), edges: a, b; their number)."""
    e = _with_degrees(ws, edges, n, task_rows)
    p = _chain_pointers(ws, e)
    side = lambda s: [F.max(F.when(F.col("s") == s, F.col(c))).alias(f"{c}{s}") for c in ("ev", "es", "ed", "rank")]
    chains = ws.keep(p.groupBy("v").agg(*side(0), *side(1), F.min("low").alias("low")), "chains")
    ws.drop(p)
    ring = F.col("es0").isNotNull()
    # An end that stays in the graph is preferred to one that is stripped in this round.
    keep0 = F.when(F.col("ed0") == 1, 1).otherwise(0) * 2 + F.when(F.col("ev0") > F.col("ev1"), 1).otherwise(0)
    keep1 = F.when(F.col("ed1") == 1, 1).otherwise(0) * 2 + F.when(F.col("ev1") > F.col("ev0"), 1).otherwise(0)
    parent = F.when(ring, F.col("low")).otherwise(F.when(keep0 <= keep1, F.col("ev0")).otherwise(F.col("ev1")))
    inner = chains.select("v", parent.alias("parent")).filter("v <> parent")
    short = chains.filter("es0 IS NULL AND (rank0 = 1 OR rank1 = 1) AND ev0 <> ev1").select(
        F.least("ev0", "ev1").alias("a"), F.greatest("ev0", "ev1").alias("b"),
        F.when(F.col("ev0") < F.col("ev1"), F.col("ed0")).otherwise(F.col("ed1")).alias("da"),
        F.when(F.col("ev0") < F.col("ev1"), F.col("ed1")).otherwise(F.col("ed0")).alias("db"),
    )
    now = ws.keep(e.filter("da <> 2 AND db <> 2").select("a", "b", "da", "db").union(short).distinct(), "compressed")
    leaf = now.filter("da = 1 OR db = 1").select(
        F.when(F.col("db") == 1, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(F.col("db") == 1, F.col("a")).otherwise(F.col("b")).alias("parent")
    )
    removed = ws.counted(inner.union(leaf), "removed")
    left, m = ws.counted(now.filter("da <> 1 AND db <> 1").select("a", "b"), "left")
    ws.drop(e, chains, now)
    return removed, left, m


def linked_groups(
    spark: SparkSession, vertices: DataFrame, pairs: DataFrame, id_col: str = "id", a: str = "row", b: str = "col",
    least_share: float = 0.1, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(id, group_id): one row for each distinct non-null id of ``vertices``; group_id is the
    smallest id linked with it over any number of pairs, itself included.

    Pairs with a null side and self-matches link nothing; repeated, reversed and parallel
    pairs link once; a pair may name ids that ``vertices`` lacks, which link but get no row.
    An id in no pair is its own group.  Rounds of stripping go on while they remove at least
    ``least_share`` of the edges; the core that is left is contracted.  Tables of more than
    ``task_rows`` rows have the rows of hot vertices spread.
    """
    ws = Workspace(spark)
    removed: list[tuple[DataFrame, int]] = []
    edges, n = ws.counted(simple_edges(pairs, a, b), "links")
    before = 0
    while n and (not removed or n <= (1 - least_share) * before):
        out, left, m = _round(ws, edges, n, task_rows)
        ws.drop(edges)
        removed.append(out)
        edges, before, n = left, n, m
    removed += contract(ws, edges, n, task_rows)
    roots = roots_of(ws, removed, task_rows)
    ids = vertices.select(F.col(f"`{id_col}`").cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    if roots is None:
        return ids.withColumn("group_id", F.col("id"))
    known = smallest_of_group(ws, roots)
    return ids.join(known, ids.id == known.v, "left").select("id", F.coalesce("low", "id").alias("group_id"))
