"""python -m weftgraph.cli bfs -g graph.mtx -o out -p "src=1 directed=1" """

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from weftgraph import config, reference, stats
from weftgraph.algorithms.components import components
from weftgraph.algorithms.pagerank import pagerank
from weftgraph.algorithms.traversal import UNREACHED_DISTANCE, bfs, sssp
from weftgraph.engine import Report
from weftgraph.sources.graphs import random_sources, read_market, read_sources
from weftgraph.sources.sinks import write_parquet, write_values

UNLIMITED = 2147483647


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description="Run a graph algorithm on a Matrix Market file.")
    p.add_argument("algorithm", choices=sorted(config.KINDS))
    p.add_argument("-g", "--graph", required=True)
    p.add_argument("-o", "--output", help="folder of a text file with one value a line, in order of id")
    p.add_argument("--parquet", help="folder for (id, value) rows")
    p.add_argument("-s", "--sources", help="RANDOM, or a file with one vertex a line")
    p.add_argument("--seed", type=int, default=0, help="for RANDOM sources")
    p.add_argument("-p", "--parameters", default="", help='"name=value name=value"')
    p.add_argument("-c", "--config", help="file of name=value pairs")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Several sources are separate runs, of which the last one's result is written."""
    a = parser().parse_args(argv)
    texts = [*([config.read_file(a.config)] if a.config else []), a.parameters]
    par = config.parse(a.algorithm, *texts)
    if idle := sorted({x for t in texts for x in config.given(a.algorithm, t) if x in config.IGNORED}):
        print(f"no effect here: {', '.join(idle)}", file=sys.stderr)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    graph, report = read_market(spark, a.graph), Report()
    cap = None if par.iter_num == UNLIMITED else par.iter_num
    if par.stats:
        stats.degree_histogram(graph).orderBy("bucket").show()
        stats.max_degree(graph).show()
    if a.algorithm in ("bfs", "sssp"):
        if a.sources == "RANDOM":
            sources = random_sources(graph, par.num_src, a.seed)
        elif a.sources:
            sources = read_sources(spark, a.sources, par.origin)
        else:
            sources = [par.src - par.origin]
        algorithm, column = {"bfs": (bfs, "level"), "sssp": (sssp, "dist")}[a.algorithm]
        for s in sources:
            out = algorithm(graph, [s], directed=par.directed, iter_num=cap, report=report)
        if a.algorithm == "bfs":
            print("traversed edges:", stats.traversed_edges(graph, out).first()[0])
    elif a.algorithm == "cc":
        out, column = components(graph, iter_num=cap, report=report), "component"
        print("components:", stats.component_count(out).first()[0])
    else:
        out, column = pagerank(graph, par.directed, par.damping, par.change_tol, cap, report), "rank"
    if par.run_CPU and cap is None:
        seen = graph.view(getattr(par, "directed", True))
        plain = {
            "bfs": lambda: reference.levels(seen, s), "sssp": lambda: reference.distances(seen, s, UNREACHED_DISTANCE),
            "cc": lambda: reference.labels(graph), "pagerank": lambda: reference.ranks(seen, par.damping, par.change_tol),
        }[a.algorithm]()
        got = {r.id: r[column] for r in out.collect()}  # the graph is small, or the plain version would have refused it
        print(reference.compared(got, plain, par.tol if a.algorithm == "pagerank" else None))
    if par.verbose:
        for s in report.supersteps:
            print(s)
    if a.output:
        write_values(out, column, a.output)
    if a.parquet:
        write_parquet(out, a.parquet)
    return 0


if __name__ == "__main__":
    sys.exit(main())
