import pytest
from graphs import INF, MINI, SMALL, TRIVIAL, by_id, graph

from weftgraph import stats
from weftgraph.algorithms.components import components
from weftgraph.algorithms.pagerank import pagerank, pagerank_delta, pagerank_fixed
from weftgraph.algorithms.traversal import bfs, per_source, predecessors, sssp, sssp_pull
from weftgraph.engine import Report
from weftgraph.model import Graph


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, SMALL)


@pytest.fixture(scope="module")
def mini(spark):
    return graph(spark, MINI)


@pytest.fixture(scope="module")
def trivial(spark):
    return graph(spark, TRIVIAL)


def test_bfs(small, trivial, mini):
    assert by_id(bfs(small, [0]), "level") == [0, 1, 1, 1, 2, 2, 2]
    assert by_id(bfs(small, [0], directed=False), "level") == [0, 1, 1, 1, 2, 2, 2]
    assert by_id(bfs(small, [0], iter_num=1), "level") == [0, 1, 1, 1, -1, -1, -1]
    assert by_id(bfs(trivial, [0], iter_num=2), "level") == [0, 1, 2, -1, -1]
    assert by_id(bfs(mini, [0]), "level") == [0, 1, 2, -1, -1, -1]


def test_sssp(small, trivial, mini):
    assert by_id(sssp(small, [0]), "dist") == [0, 1, 4, 1, 2, 2, 2]
    assert by_id(sssp(small, [0], directed=False), "dist") == [0, 1, 2, 1, 2, 2, 2]
    assert by_id(sssp(small, [0], iter_num=1), "dist") == [0] + [INF] * 6
    assert by_id(sssp(small, [0], iter_num=2), "dist") == [0, 1, 4, 1, INF, INF, INF]
    assert by_id(sssp(trivial, [0]), "dist") == [0, 1, 2, 3, 4]
    assert by_id(sssp(mini, [0]), "dist") == [0, 2, 3, INF, INF, INF]
    assert by_id(sssp_pull(small, [0]), "dist") == [0, 1, 4, 1, 2, 2, 2]


def test_negative_cycle_raises(spark):
    g = Graph.of(spark.range(2), spark.createDataFrame([(0, 1, -2), (1, 0, 1)], "src long, dst long, w long"))
    with pytest.raises(RuntimeError):
        sssp(g, [0])
    with pytest.raises(RuntimeError):
        sssp_pull(g, [0])


def test_predecessors(small, trivial):
    assert by_id(predecessors(small, bfs(small, [0])), "pred") == [-1, 0, 0, 0, 2, 3, 3]
    assert by_id(predecessors(trivial, bfs(trivial, [0])), "pred") == [-1, 0, 1, 2, 3]


def test_components(small, mini, spark):
    for mode in ("contract", "propagate"):
        assert by_id(components(small, mode), "component") == [0] * 7
        assert by_id(components(mini, mode), "component") == [0, 0, 0, 3, 3, 5]
    assert by_id(components(mini, task_rows=0), "component") == [0, 0, 0, 3, 3, 5]
    chain = Graph.of(spark.range(40), spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long"))
    assert by_id(components(chain, task_rows=0), "component") == [0] * 31 + list(range(31, 40))
    assert stats.component_count(components(mini)).first()[0] == 3


def test_pagerank(small, trivial, mini):
    close = lambda x: pytest.approx(x, abs=2e-4)
    assert by_id(pagerank(small), "rank") == close([0.15, 0.247042, 0.1925, 0.1925, 0.414527, 0.286354, 0.827562])
    assert by_id(pagerank(small, iter_num=1), "rank") == close([0.15, 0.235, 0.1925, 0.1925, 0.32, 0.25625, 0.46875])
    assert by_id(pagerank(small, iter_num=2), "rank") == close([0.15, 0.247042, 0.1925, 0.1925, 0.404292, 0.286354, 0.721625])
    assert by_id(pagerank(mini), "rank") == close([0.7218, 0.7421, 1.3526, 0.15, 0.2775, 0.15])
    report = Report()
    assert by_id(pagerank(small, report=report), "rank") and report.converged and len(report.supersteps) == 4


def test_pagerank_undirected_counts_loops_twice(mini):
    assert by_id(pagerank(mini, directed=False), "rank") == pytest.approx([0.8764, 0.8764, 1.1103, 0.9464, 0.9464, 0.15], abs=2e-4)


def test_pagerank_modes_agree_at_the_fixed_point(small):
    exact = by_id(pagerank_fixed(small, 12), "rank")
    assert by_id(pagerank_delta(small, change_tol=1e-9), "rank") == pytest.approx(exact, abs=1e-6)
    assert by_id(pagerank(small, change_tol=1e-9), "rank") == pytest.approx(exact, abs=1e-6)


def test_stats(small, mini):
    hist = lambda g: {r.bucket: r.n for r in stats.degree_histogram(g).collect()}
    assert hist(small) == {-1: 1, 0: 3, 1: 3}
    assert hist(mini) == {-1: 2, 0: 2, 1: 2}
    assert stats.max_degree(small).first()[:] == (0, 3)
    assert stats.max_degree(mini).first()[:] == (0, 2)
    assert stats.traversed_edges(small, bfs(small, [0])).first()[0] == 11
    assert by_id(stats.degrees(mini, directed=False), "degree") == [3, 3, 4, 1, 1, 0]
    assert by_id(stats.offsets(mini), "offset") == [0, 2, 3, 5, 6, 6]
    assert [r.id for r in stats.indices(stats.offsets(mini).join(stats.degrees(mini), "id")).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 3]
    assert stats.adjacency(mini).orderBy("id").first()[:] == (0, [1, 1], [2])


def test_undirected_is_both_ways(small):
    assert by_id(sssp(small, [2], directed=False), "dist") == by_id(sssp(small.both_ways(), [2]), "dist")


def test_several_sources(small):
    rows = per_source(bfs, small, [0, 2]).collect()
    assert {(r.source, r.id, r.level) for r in rows if r.id == 1} == {(0, 1, 1), (2, 1, 1)} and len(rows) == 14
    assert by_id(bfs(small, [0, 6]), "level") == [0, 1, 1, 1, 2, 2, 0]


def test_empty_graph(spark):
    g = Graph.of(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    assert bfs(g, [0]).count() == components(g).count() == pagerank(g).count() == stats.max_degree(g).count() == 0
