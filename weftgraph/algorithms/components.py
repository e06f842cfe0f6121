"""Connected components: the smallest vertex id linked over edges in either direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.algorithms.contract import contract, roots_of, simple_edges, smallest_of_group
from weftgraph.engine import Report, run
from weftgraph.model import Graph
from weftgraph.operators.hot import TASK_ROWS
from weftgraph.program import Along, Program
from weftgraph.session import Workspace

CC = Program(
    init=lambda id_, source: {"component": id_},
    sources_only=False,
    apply=lambda s, msg, step: {"component": F.least(s("component"), msg)},
    changed=lambda s, new, msg, step: F.lit(True) if step == 0 else msg < s("component"),
    expand=Along.ALL,
    expand_edge=lambda s, e: s("component"),
    combine="min",
    accept=lambda s, msg: msg < s("component"),
)


def components(graph: Graph, mode: str = "contract", iter_num: int | None = None, task_rows: int = TASK_ROWS, report: Report | None = None) -> DataFrame:
    """(id, component): the smallest id linked with each vertex; isolated vertices label themselves.

    ``propagate`` sends labels along edges, one superstep for each step of the diameter, and
    is what ``iter_num`` k (labels from at most k - 1 edges away) needs.  ``contract`` gives
    the same labels in a number of rounds that grows with the logarithm of the vertices, and
    runs the same way at every size.  Beyond ``task_rows`` rows, hubs are spread.
    """
    if mode == "propagate" or iter_num is not None:
        return run(graph, CC, iter_num=iter_num, report=report)
    ws = Workspace(graph.vertices.sparkSession)
    roots = roots_of(ws, contract(ws, *ws.counted(simple_edges(graph.edges, "src", "dst"), "edges"), task_rows), task_rows)
    if roots is None:
        return graph.vertices.select("id", F.col("id").alias("component"))
    low = smallest_of_group(ws, roots)
    return graph.vertices.join(low, graph.vertices.id == low.v, "left").select("id", F.coalesce("low", "id").alias("component"))
