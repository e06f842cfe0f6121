import pytest
from graphs import SMALL, edges, graph

from weftgraph import cli, config
from weftgraph.sources import generators
from weftgraph.sources import graphs as read
from weftgraph.sources import sinks
from weftgraph.sources.errors import BadEdge, BadHeader, BadVertex, NoGraph, NotSquare, SpliceMismatch, WrongCount

MTX = "%%MatrixMarket matrix coordinate real general\n% a comment\n7 7 11\n" + "".join(f"{a + 1} {b + 1} {w}\n" for a, b, w in edges(SMALL[1]))


def stored(g):
    return sorted(tuple(r) for r in g.edges.collect())


def put(path, text):
    path.write_text(text)
    return str(path)


def test_market(spark, tmp_path):
    g = read.read_market(spark, put(tmp_path / "a.mtx", MTX))
    assert stored(g) == sorted(edges(SMALL[1])) and g.vertices.count() == 7
    assert read.read_market(spark, put(tmp_path / "b.mtx", MTX), undirected=True).edges.count() == 22
    g = read.read_market(spark, put(tmp_path / "c.mtx", "3 3 2\n1 2\n2\t3 4.9\n"))
    assert stored(g) == [(0, 1, 1), (1, 2, 4)]


@pytest.mark.parametrize(
    ("text", "error"),
    [("", NoGraph), ("% only\n", NoGraph), ("3 x 2\n", BadHeader), ("3 4 1\n1 2\n", NotSquare), ("3 3 2\n1 2\n", WrongCount), ("3 3 1\n1 2\n2 3\n", WrongCount), ("3 3 1\n1\n", BadEdge), ("3 3 1\n1 4\n", BadVertex)],
)
def test_market_errors(spark, tmp_path, text, error):
    with pytest.raises(error):
        read.read_market(spark, put(tmp_path / "x.mtx", text))


def test_parts_of_a_folder_are_one_text(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    lines = MTX.splitlines(keepends=True)
    for k, at in enumerate(range(0, len(lines), 4)):
        put(folder / f"part-{k:05d}", "".join(lines[at : at + 4]))
    assert stored(read.read_market(spark, str(folder))) == sorted(edges(SMALL[1]))


def test_dimacs(spark, tmp_path):
    put(tmp_path / "d.0", "c hi\np sp 4 2\na 1 2 7\na 2 3 8\n")
    put(tmp_path / "d.1", "p sp 4 1\na 4 1 9\n")
    put(tmp_path / "e.0", "p sp 5 0\n")
    put(tmp_path / "e.1", "p sp 4 0\n")
    assert stored(read.read_dimacs(spark, str(tmp_path / "d"), splice=2)) == [(0, 1, 7), (1, 2, 8), (3, 0, 9)]
    with pytest.raises(SpliceMismatch):
        read.read_dimacs(spark, str(tmp_path / "e"), splice=2)


def test_metis_round_trip(spark, tmp_path):
    g = read.read_metis(spark, put(tmp_path / "m", "4 2\n2 3\n1\n1\n\n"))
    assert stored(g) == [(0, 1, 1), (0, 2, 1), (1, 0, 1), (2, 0, 1)] and g.vertices.count() == 4
    sinks.write_metis(g, str(tmp_path / "out"))
    assert stored(read.read_metis(spark, str(tmp_path / "out"))) == stored(g)
    sinks.join_parts(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    assert (tmp_path / "one").read_text() == "4 2\n2 3\n1\n1\n\n"
    with pytest.raises(WrongCount):
        read.read_metis(spark, put(tmp_path / "n", "3 5\n2\n1\n\n"))


def test_coordinates_and_sources(spark, tmp_path):
    assert stored(read.read_coordinates(spark, put(tmp_path / "c", "3 2\n0 1 0.5\n1 2 2\n"))) == [(0, 1, 0.5), (1, 2, 2.0)]
    assert read.read_sources(spark, put(tmp_path / "s", "5\n3\n")) == [4, 2]
    g = graph(spark, SMALL)
    got = read.random_sources(g, 20, seed=3)
    assert len(got) == 20 and set(got) <= {0, 1, 2, 3, 4, 5} and got == read.random_sources(g, 20, seed=3)


def test_matrix(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate {} {}\n3 3 2\n"
    m, h, w = read.read_matrix(spark, put(tmp_path / "s", head.format("real", "symmetric") + "2 1 5\n3 3 1\n"))
    assert sorted(tuple(r) for r in m.collect()) == [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 1.0)] and (h, w) == (3, 3)
    m, _, _ = read.read_matrix(spark, put(tmp_path / "k", head.format("real", "skew-symmetric") + "2 1 5\n3 1 1\n"))
    assert sorted(tuple(r) for r in m.collect()) == [(0, 1, -5.0), (0, 2, -1.0), (1, 0, 5.0), (2, 0, 1.0)]
    m, _, _ = read.read_matrix(spark, put(tmp_path / "p", head.format("pattern", "general") + "2 1\n3 1\n"))
    assert {r.value for r in m.collect()} == {1.0}
    sinks.write_market(m, 3, 3, str(tmp_path / "out"), pattern=True)
    again, _, _ = read.read_matrix(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in m.collect())
    sinks.store_matrix(m, str(tmp_path / "bin"))
    assert sinks.load_matrix(spark, str(tmp_path / "bin")).count() == 2
    plain, weighted = sinks.snap_edges(m, "symmetric", seed=1)
    assert plain.count() == 4 and {0 <= r.w <= 100 for r in weighted.collect()} == {True}


def test_generators(spark):
    degrees = lambda g: sorted(r["count"] for r in g.edges.groupBy("src").count().collect())
    g = generators.grid2d(spark, 4)
    assert g.edges.count() == 16 + 4 * 4 * 3 and degrees(g)[-1] == 5 and g.edges.filter("src = dst").count() == 16
    assert generators.grid3d(spark, 3).edges.count() == 27 + 6 * 9 * 2
    assert degrees(generators.regularish(spark, 10, 3)) == [3] * 10
    for make in (generators.random_graph, generators.rmat):
        g = make(spark, 50, 400, seed=4)
        assert g.edges.count() == 400 and g.edges.filter("src < 0 OR src > 49 OR dst < 0 OR dst > 49").count() == 0
        assert stored(g) == stored(make(spark, 50, 400, seed=4)) != stored(make(spark, 50, 400, seed=5))
    skewed = degrees(generators.rmat(spark, 64, 2000, 0.6, 0.15, 0.15, 0.1))
    assert skewed[-1] > 3 * 2000 / 64
    a = [r.val for r in generators.random_array(spark, 100, 5, 9, ordered=True).orderBy("pos").collect()]
    assert a == sorted(a) and set(a) == {5, 6, 7, 8, 9}


def test_config():
    assert config.parse("bfs", "src=4, directed=0\niter_num=3") == config.Traversal(src=4, directed=False, iter_num=3)
    assert config.parse("bfs", "directed=0 src=5", "directed=1 src=1") == config.Traversal()
    assert config.parse("pagerank", "max_queue_sizing=3 device=1 threshold=5 with_value=1 run_CPU=1").run_CPU
    for bad in ("what=1", "src=x", "src"):
        with pytest.raises(ValueError):
            config.parse("bfs", bad)


@pytest.mark.parametrize(("algorithm", "want"), [("bfs", "0 1 1 1 2 2 2"), ("sssp", "0 1 4 1 2 2 2"), ("cc", "0 0 0 0 0 0 0"), ("pagerank", "0.150000 0.247042")])
def test_command_line(spark, tmp_path, algorithm, want):
    out = tmp_path / "out"
    cli.main([algorithm, "-g", put(tmp_path / "g.mtx", MTX), "-o", str(out), "-p", "stats=1" if algorithm == "cc" else ""], spark)
    lines = "".join(p.read_text() for p in sorted(out.glob("part-*"))).split()
    assert lines[: len(want.split())] == want.split()


def test_given_parameters_stand_above_the_file(spark, tmp_path, capsys):
    out = tmp_path / "out"
    cli.main(["bfs", "-g", put(tmp_path / "g.mtx", MTX), "-o", str(out), "-c", put(tmp_path / "c", "directed=0 src=5"), "-p", "directed=1 src=1 device=1"], spark)
    assert "".join(p.read_text() for p in sorted(out.glob("part-*"))).split() == "0 1 1 1 2 2 2".split()
    assert "no effect here: device" in capsys.readouterr().err


@pytest.mark.parametrize(("algorithm", "want"), [("bfs", "CPU: 0 of 7 values differ"), ("sssp", "CPU: 0 of 7 values differ"), ("cc", "CPU: 0 of 7 values differ"), ("pagerank", "pass at 0.1")])
def test_comparison_with_the_plain_version(spark, tmp_path, capsys, algorithm, want):
    cli.main([algorithm, "-g", put(tmp_path / "g.mtx", MTX), "-p", "run_CPU=1"], spark)
    assert want in capsys.readouterr().out
