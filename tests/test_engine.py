"""Both plans of a superstep, hubs, hooks of programs, and what is left behind."""

import dataclasses
import random

import pytest
from graphs import SMALL, by_id, graph
from pyspark.sql import functions as F

from weftgraph import engine
from weftgraph.algorithms import pagerank as ranks
from weftgraph.algorithms.traversal import BFS, SSSP, ids
from weftgraph.engine import Report, run
from weftgraph.model import Graph


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all edges leave vertex 0; a chain hangs on it."""
    r = random.Random(8)
    e = [(0, i, r.randrange(1, 9)) for i in range(1, 101)] + [(i, i + 1, 1) for i in range(100, 105)] + [(r.randrange(100), r.randrange(100), r.randrange(1, 9)) for _ in range(180)]
    return e, Graph.of(spark.range(108), spark.createDataFrame(e, "src long, dst long, w long"))


def shortest(edges, source):
    dist = {source: 0}
    for _ in range(130):
        for a, b, w in edges:
            if a in dist and dist[a] + w < dist.get(b, 10**9):
                dist[b] = dist[a] + w
    return dist


@pytest.mark.parametrize("sparse", [0, 8, 10**9])
def test_plans_agree(spark, skewed, monkeypatch, sparse):
    """Only sparse supersteps, both kinds, and only dense ones."""
    monkeypatch.setattr(engine, "SPARSE", sparse)
    monkeypatch.setattr(engine, "PASS_ROWS", 0)
    monkeypatch.setattr(engine, "DELTAS", 2)
    edges, g = skewed
    report = Report()
    got = {r.id: r.dist for r in run(g, SSSP, ids(g, [0]), report=report).collect() if r.dist is not None}
    assert got == shortest(edges, 0) and report.hubs >= 1 and report.converged
    assert {s["plan"] for s in report.supersteps} == {0: {"sparse"}, 8: {"sparse", "dense"}, 10**9: {"dense"}}[sparse]


@pytest.mark.parametrize("sparse", [0, 10**9])
def test_gathering_plans_agree(spark, monkeypatch, sparse):
    monkeypatch.setattr(engine, "PASS_ROWS", 0)
    monkeypatch.setattr(engine, "SPARSE", sparse)
    got = by_id(ranks.pagerank(graph(spark, SMALL)), "rank")
    assert got == pytest.approx([0.15, 0.247042, 0.1925, 0.1925, 0.414527, 0.286354, 0.827562], abs=2e-4)


def test_gather_and_expand_along_other_edges(spark, monkeypatch):
    """A program that gathers over the edges it also sends along takes two passes."""
    odd = dataclasses.replace(ranks.program(), gather=engine.Along.OUT, gather_edge=lambda s, e: s("rank"), gather_sum="max", apply=lambda s, got, step: {"rank": got}, changed=lambda s, new, got, step: got != s("rank"))
    out = []
    monkeypatch.setattr(engine, "PASS_ROWS", 0)
    for sparse in (0, 10**9):
        monkeypatch.setattr(engine, "SPARSE", sparse)
        out.append(by_id(run(graph(spark, SMALL), odd), "rank"))
    assert out[0] == out[1]


def test_hooks(spark, skewed):
    edges, g = skewed
    light = dataclasses.replace(SSSP, keep_edge=lambda s, e: e("w") < 5)
    got = {r.id: r.dist for r in run(g, light, ids(g, [0])).collect() if r.dist is not None}
    assert got == shortest([x for x in edges if x[2] < 5], 0)
    ends = dataclasses.replace(BFS, expand_vertex=lambda s, step: F.col("id") < 103)
    got = {r.id: r.level for r in run(g, ends, ids(g, [0])).collect() if r.level is not None}
    assert got[103] == 4 and 104 not in got


def test_nothing_stays_in_the_catalog(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        before = spark.catalog.listTables()
        ws = engine.Workspace(spark)
        ws.keep(spark.range(5), "t", "id", 2)
        assert spark.catalog.listTables() == before and ws.database in [d.name for d in spark.catalog.listDatabases()]
        ws.close()
        assert ws.database not in [d.name for d in spark.catalog.listDatabases()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_a_cluster_needs_a_shared_folder():
    from weftgraph.session import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session()) == Session.conf["spark.checkpoint.dir"]
