"""PageRank as a fixed point over active vertices, in fixed rounds, and by deltas.

Ranks are not normalised and vertices without out-edges pass nothing on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.engine import Layout, Report, run
from weftgraph.model import Graph
from weftgraph.program import Along, Program
from weftgraph.session import Workspace
from weftgraph.stats import degrees

DAMPING, CHANGE_TOL = 0.85, 0.01


def program(damping: float = DAMPING, change_tol: float = CHANGE_TOL) -> Program:
    base = 1 - damping
    return Program(
        init=lambda id_, source: {"rank": F.lit(round(base, 12)), "degree": F.col("degree")},
        sources_only=False,
        gather=Along.IN,
        gather_edge=lambda s, e: s("rank") / s("degree"),
        gather_sum="sum",
        gather_identity=0.0,
        apply=lambda s, got, step: {"rank": round(base, 12) + damping * got},
        changed=lambda s, new, got, step: F.abs(round(base, 12) + damping * got - s("rank")) >= change_tol,
        max_supersteps=100_000,
        extra={"degree": degrees},
    )


def pagerank(graph: Graph, directed: bool = True, damping: float = DAMPING, change_tol: float = CHANGE_TOL, iter_num: int | None = None, report: Report | None = None, pass_rows: int | None = None) -> DataFrame:
    """(id, rank): all vertices start with 1 - damping; a vertex is recomputed when one with
    an edge to it moved by at least ``change_tol``; ends when none did.  If not ``directed``,
    edges count both ways, for degrees too.  ``iter_num`` caps the supersteps."""
    return run(graph.view(directed), program(damping, change_tol), iter_num=iter_num, report=report, pass_rows=pass_rows).select("id", "rank")


def pagerank_fixed(graph: Graph, rounds: int, directed: bool = True, damping: float = DAMPING) -> DataFrame:
    """(id, rank): every vertex recomputed in each of exactly ``rounds`` rounds."""
    return run(graph.view(directed), program(damping, 0.0), iter_num=rounds).select("id", "rank") if rounds == 0 else _rounds(graph.view(directed), rounds, damping)


def _laid_out(g: Graph) -> tuple[Workspace, Layout, Graph]:
    ws, seen = Workspace(g.vertices.sparkSession), Observation()
    edges = ws.keep(g.edges.observe(seen, F.count(F.lit(1)).alias("n")), "graph")
    return ws, Layout(ws, edges, Along.OUT, seen.get["n"]), Graph(g.vertices, edges)


def _rounds(g: Graph, rounds: int, damping: float) -> DataFrame:
    base, (ws, out, g) = round(1 - damping, 12), _laid_out(g)
    v = ws.keep(degrees(g).withColumn("rank", F.lit(base)), "ranks", "id", out.buckets, place=True)
    for _ in range(rounds):
        got = out.join(v).groupBy(F.col("u").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = ws.keep(v.join(got, "id", "left").select("id", "degree", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "ranks", "id", out.buckets)
        ws.drop(v)
        v = new
    return v.select("id", "rank")


def pagerank_delta(graph: Graph, directed: bool = True, damping: float = DAMPING, change_tol: float = CHANGE_TOL, max_rounds: int = 1000) -> DataFrame:
    """(id, rank): only changes travel.  Each vertex keeps what it has not passed on yet and
    passes it on once it reaches ``change_tol``; ends when no vertex has that much left.
    More than ``max_rounds`` rounds raise RuntimeError."""
    base, (ws, out, g) = round(1 - damping, 12), _laid_out(graph.view(directed))
    waits = F.abs("due") >= change_tol

    def keep(df: DataFrame, place: bool = False) -> tuple[DataFrame, int]:
        seen = Observation()
        return ws.keep(df.observe(seen, F.count_if(waits).alias("n")), "deltas", "id", out.buckets, place), seen.get["n"]

    v, waiting = keep(degrees(g).select("id", "degree", F.lit(base).alias("rank"), F.lit(base).alias("due")), place=True)
    step = 0
    while waiting:
        if step >= max_rounds:
            raise RuntimeError(f"vertices still hold {change_tol} or more after {step} rounds")
        got = out.join(v.filter(waits)).groupBy(F.col("u").alias("id")).agg((damping * F.sum(F.col("due") / F.col("degree"))).alias("got"))
        more, kept = F.coalesce("got", F.lit(0.0)), F.when(waits, 0.0).otherwise(F.col("due"))
        old = v
        v, waiting = keep(v.join(got, "id", "left").select("id", "degree", (F.col("rank") + more).alias("rank"), (kept + more).alias("due")))
        ws.drop(old)
        step += 1
    return v.select("id", "rank")
