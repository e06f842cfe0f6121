"""Breadth-first levels and predecessors, and shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.engine import Layout, Report, gather, run
from weftgraph.model import Graph
from weftgraph.program import Along, Program
from weftgraph.session import Workspace

UNREACHED_LEVEL = -1
UNREACHED_DISTANCE = 2147483647

BFS = Program(
    init=lambda id_, source: {"level": F.when(source, F.lit(0).cast("bigint"))},
    accept=lambda s, msg: s("level").isNull(),
    contract=lambda s, msg, step: {"level": F.lit(step + 1).cast("bigint")},
)

SSSP = Program(
    init=lambda id_, source: {"dist": F.when(source, F.lit(0).cast("bigint"))},
    apply=lambda s, msg, step: {"dist": F.least(s("dist"), msg)},
    changed=lambda s, new, msg, step: F.lit(True) if step == 0 else s("dist").isNull() | (msg < s("dist")),
    expand_edge=lambda s, e: s("dist") + e("w"),
    combine="min",
    accept=lambda s, msg: s("dist").isNull() | (msg < s("dist")),
)


def ids(graph: Graph, sources: list[int]) -> DataFrame:
    return graph.vertices.sparkSession.createDataFrame([(int(s),) for s in sources], "id bigint")


def bfs(graph: Graph, sources: list[int], directed: bool = True, iter_num: int | None = None, report: Report | None = None, pass_rows: int | None = None) -> DataFrame:
    """(id, level): smallest number of edges from the nearest source, -1 if there is no path.
    ``iter_num`` k keeps levels 0 to k."""
    out = run(graph.view(directed), BFS, ids(graph, sources), iter_num, report=report, pass_rows=pass_rows)
    return out.select("id", F.coalesce("level", F.lit(UNREACHED_LEVEL)).alias("level"))


def predecessors(graph: Graph, levels: DataFrame, directed: bool = True, compat: bool = False) -> DataFrame:
    """(id, pred): the largest in-neighbour one level nearer to the source, else -1.

    Sources and unreached vertices have -1, and edges are taken both ways if not ``directed``.
    ``compat``: only stored edges count, and a source may name an unreached neighbour.
    """
    e = graph.edges if compat else graph.view(directed).edges
    near = levels.select(F.col("id").alias("src"), F.col("level").alias("l0"))
    far = levels.select(F.col("id").alias("dst"), F.col("level").alias("l1"))
    step = e.join(near, "src").join(far, "dst").filter("l1 - l0 = 1")
    if not compat:
        step = step.filter("l0 >= 0")
    best = step.groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("pred"))
    return levels.select("id").join(best, "id", "left").select("id", F.coalesce("pred", F.lit(-1)).cast("bigint").alias("pred"))


def sssp(graph: Graph, sources: list[int], directed: bool = True, iter_num: int | None = None, max_supersteps: int | None = None, report: Report | None = None, pass_rows: int | None = None) -> DataFrame:
    """(id, dist): smallest weight of a path from the nearest source, 2147483647 if there is none.

    Messages arrive one superstep after they were sent: ``iter_num`` k keeps paths of at most
    k - 1 edges.  Negative weights are allowed; a negative cycle raises RuntimeError.
    """
    out = run(graph.view(directed), SSSP, ids(graph, sources), iter_num, max_supersteps, report, pass_rows)
    return out.select("id", F.coalesce("dist", F.lit(UNREACHED_DISTANCE)).alias("dist"))


def sssp_pull(graph: Graph, sources: list[int], directed: bool = True) -> DataFrame:
    """The same distances by pulling: vertices next to a changed one take the smallest
    distance over their in-edges until nothing changes."""
    g, ws, seen = graph.view(directed), Workspace(graph.vertices.sparkSession), Observation()
    edges = ws.keep(g.edges.observe(seen, F.count(F.lit(1)).alias("n")), "graph")
    out, into = (Layout(ws, edges, along, seen.get["n"]) for along in (Along.OUT, Along.IN))

    def keep(df: DataFrame, place: bool = False) -> tuple[DataFrame, int, int]:
        o = Observation()
        kept = ws.keep(df.observe(o, F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed")), "dist", "id", out.buckets, place)
        return kept, o.get["changed"], o.get["n"]

    start = ids(graph, sources).distinct().withColumn("d0", F.lit(0).cast("bigint"))
    first = g.vertices.join(start, "id", "left").select("id", F.col("d0").alias("dist"), F.col("d0").isNotNull().alias("changed"))
    v, changed, n = keep(first, place=True)
    step = 0
    while changed:
        if step > n:
            raise RuntimeError("distances still fall: there is a negative cycle")
        touched = out.join(v.filter("changed").select("id")).select(F.col("u").alias("id")).distinct()
        got = gather(touched, v.select("id", "dist"), into, Along.IN, lambda s, e: s("dist") + e("w"), "min", None)
        better = F.col("gathered").isNotNull() & (F.col("dist").isNull() | (F.col("gathered") < F.col("dist")))
        old = v
        v, changed, _ = keep(v.join(got, "id", "left").select("id", F.when(better, F.col("gathered")).otherwise(F.col("dist")).alias("dist"), better.alias("changed")))
        ws.drop(old)
        step += 1
    return v.select("id", F.coalesce("dist", F.lit(UNREACHED_DISTANCE)).alias("dist"))


def per_source(algorithm, graph: Graph, sources: list[int], **options: object) -> DataFrame:  # noqa: ANN001
    """(source, id, ...): one run for each source."""
    runs = [algorithm(graph, [s], **options).withColumn("source", F.lit(int(s)).cast("bigint")) for s in sources]
    return reduce(DataFrame.unionByName, runs)
