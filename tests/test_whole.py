"""Queries that run an operator over whole tables, against brute force on small ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphs import TRIVIAL, graph
from weftgraph.algorithms.pagerank import pagerank_delta
from weftgraph.operators import relational
from weftgraph.plans import array_queries, graph_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A function that writes tables, given as rows and a schema text, and returns their folder."""

    def write(**named):
        d = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))
        return str(d)

    return write


def test_whole_product(spark, tables):
    elements = [(p, s, p % 7 + s) for p in (1, 51, 201, 251, 401) for s in (1, 2, 9) if (p + s) % 5] + [(1, 2, 4)]
    d = tables(lineitem=([(p, s, float(q)) for p, s, q in elements], "l_partkey long, l_suppkey long, l_quantity double"))
    m = Counter()
    for p, s, q in elements:
        m[p, s] += q
    want, n = Counter(), Counter()
    for (p, s), x in m.items():
        for (q, t), y in m.items():
            if s == t:
                want[p, q] += x * y
                n[p, q] += 1
    got = {(r.row, r.col): (r.value, r.n) for r in array_queries.QUERIES["spgemm_whole"](spark, d).collect()}
    assert got == {k: (float(v), n[k]) for k, v in want.items()} and (1, 401) in got


def test_product_in_blocks(make):
    """Parallel, null and hot elements; sums of products are not moved."""
    a = [(i % 40, i % 7, float(i)) for i in range(300)] + [(None, 3, 2.0), (5, None, 1.0), (6, 6, None)] + [(50, k, 1.0) for k in range(7)]
    b = [(i % 9, i % 30, float(i % 5)) for i in range(200)] + [(3, None, 2.0), (None, 4, 1.0)]
    frames = [make(rows, "row long, col long, value double") for rows in (a, b)]
    want, n = {}, Counter()
    for i, k, x in a:
        for m, j, y in b:
            if k == m and k is not None:
                n[i, j] += 1
                if x is not None:
                    want[i, j] = want.get((i, j), 0) + x * y
    for block in (10, 10**9):
        out = relational.spgemm(*frames, block=block)
        assert {(r.row, r.col): r.n for r in out.collect()} == n
        assert {(r.row, r.col): r.value for r in out.collect() if r.value is not None} == want
    plan = relational.spgemm(*frames, block=10)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]  # noqa: SLF001
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
def test_whole_joins_with_a_hot_key(spark, tables, kind):
    a = [(i, 7 if i % 3 == 0 else i % 20) for i in range(1, 61)]
    b = [(i, 7 if i % 3 == 0 else i % 20 + 10) for i in range(1, 46)]
    d = tables(part=(a, "p_partkey long, p_size int"), customer=(b, "c_custkey long, c_nationkey int"))
    want = Counter((k, i, j) for i, k in a for j, m in b if k == m)
    assert sum(n for (k, _, _), n in want.items() if k == 7) >= 20 * 15
    if kind in ("left", "full"):
        want.update((k, i, -1) for i, k in a if k not in dict(map(reversed, b)))
    if kind in ("right", "full"):
        want.update((m, -1, j) for j, m in b if m not in dict(map(reversed, a)))
    got = Counter(map(tuple, array_queries.QUERIES[f"join_{kind}_whole"](spark, d).collect()))
    assert got == want


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
def test_joins_in_blocks_of_pairs(make, kind):
    """Key 7 has 1,200 pairs, key 8 as many with one row on one side, key 9 ten; 1, 2 and null have no partner."""
    a = [(i, 7) for i in range(40)] + [(100, 8), (101, 9), (102, 9), (103, 1), (104, None)]
    b = [(i, 7) for i in range(30)] + [(i, 8) for i in range(100, 1300)] + [(i, 9) for i in range(2000, 2005)] + [(3000, 2), (3001, None)]
    want = Counter((k, i, j) for i, k in a for j, m in b if k == m and k is not None)
    if kind in ("left", "full"):
        want.update([(1, 103, -1), (None, 104, -1)])
    if kind in ("right", "full"):
        want.update([(2, -1, 3000), (None, -1, 3001)])
    frames = [make(rows, "pos long, key long") for rows in (a, b)]
    got = relational.relational_join(*frames, kind, block=100)
    assert Counter(map(tuple, got.collect())) == want
    # No task makes all pairs of a hot key, and none holds them in memory.
    assert max(r.n for r in got.groupBy(F.spark_partition_id(), "key").agg(F.count("*").alias("n")).collect()) < 1000
    assert "FullOuter" not in got._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


# A chain of parts in orders of two lines, longer than two hops; sizes on both sides of 5.
CHAIN = [(1, 2, 3), (2, 3, 1), (3, 4, 8), (4, 5, 2), (4, 2, 5), (6, 1, 4)]
SIZES = {1: 1, 2: 9, 3: 50, 4: 5, 5: 6, 6: 30, 7: 8}
SIDES = {"out": [(a, b, w) for a, b, w in CHAIN], "in": [(b, a, w) for a, b, w in CHAIN]}
SIDES["all"] = SIDES["out"] + SIDES["in"]


@pytest.fixture(scope="module")
def chain(tables):
    lines = [(o, n, p, 1, float(w)) for o, (a, b, w) in enumerate(CHAIN) for n, p in ((1, a), (2, b))]
    return tables(
        part=(list(SIZES.items()), "p_partkey long, p_size int"),
        lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"),
    )


@pytest.mark.parametrize("name, active", [("{}_whole", SIZES), ("{}", [v for v, size in SIZES.items() if size <= 5])])
@pytest.mark.parametrize("side", list(SIDES))
def test_gather_and_expand(spark, chain, side, name, active):
    run = lambda kind: {tuple(r) for r in graph_queries.QUERIES[name.format(f"{kind}_{side}")](spark, chain).collect()}
    assert run("gas_gather") == {(v, sum(SIZES[u] + w for x, u, w in SIDES[side] if x == v)) for v in active}
    sent = [(u, SIZES[v] + w) for v, u, w in SIDES[side] if v in active]
    assert run("expand") == {(u, min(m for x, m in sent if x == u)) for u, _ in sent}


def test_traversed_edges_beyond_two_hops(spark, chain):
    assert graph_queries.QUERIES["bfs_traversed_edges_whole"](spark, chain).first().traversed == 5
    assert graph_queries.QUERIES["bfs_traversed_edges"](spark, chain).first().traversed == 3


def test_counting_reaches_the_largest_key(spark, tables):
    run = lambda rows: sorted(map(tuple, array_queries.QUERIES["counting_step"](spark, tables(part=(rows, "p_partkey long"))).collect()))
    assert run([(1,), (10_000_001,)]) == [(1, 8), (10_000_001, 30_000_008)]
    assert run([]) == []


def test_deltas_that_have_not_settled_raise(spark):
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        pagerank_delta(graph(spark, TRIVIAL), max_rounds=2)
    assert pagerank_delta(graph(spark, TRIVIAL), change_tol=0.2, max_rounds=0).count() == 5
