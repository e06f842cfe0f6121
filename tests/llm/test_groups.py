import random

import pytest

from weftgraph.llm.groups import linked_groups


def brute(ids, pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and (a := find(a)) != (b := find(b)):
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if i is not None}


def shapes():
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 180)]
    ring = [(200 + i, 200 + (i + 1) % 23) for i in range(23)]
    star = [(300, 300 + i) for i in range(1, 40)]
    comb = [(400 + i, 401 + i) for i in range(20)] + [(400 + i, 450 + i) for i in range(20)]
    clique = [(500 + i, 500 + j) for i in range(7) for j in range(i)]
    theta = [(600, 610), (610, 601), (600, 611), (611, 612), (612, 601), (600, 601)]
    lollipop = [(700, 701), (701, 702), (702, 700), (702, 703), (703, 704), (704, 705)]
    loops = [(800, 801), (801, 802), (802, 800), (800, 803), (803, 804), (804, 800)]
    dense = [(r.randrange(900, 960), r.randrange(900, 960)) for _ in range(300)]
    pairs = chain + ring + star + comb + clique + theta + lollipop + loops + dense
    dirty = [(b, a) for a, b in pairs[::3]] + pairs[::5] + [(5, 5), (None, 100), (101, None), (1, 2)]
    out = pairs + dirty
    r.shuffle(out)
    return out


@pytest.mark.parametrize("task_rows", [0, 1_000_000])
def test_groups(make, spark, task_rows):
    pairs = shapes()
    ids = list(range(0, 1000)) + [100, 100, None]
    v = make([(i, "x") for i in ids], "id long, label string")
    p = make([(i, a, b, 0.5) for i, (a, b) in enumerate(pairs)], "pair_id long, row long, col long, value double")
    got = linked_groups(spark, v, p, task_rows=task_rows).collect()
    assert len(got) == 1000 and {r.id: r.group_id for r in got} == brute(ids, pairs)


def test_a_pair_may_name_unknown_ids(make, spark):
    v, p = make([(5,), (7,)], "id long"), make([(5, 3), (3, 7)], "row long, col long")
    assert {r.id: r.group_id for r in linked_groups(spark, v, p).collect()} == {5: 3, 7: 3}


def test_no_links_and_no_vertices(make, spark):
    v, p = make([(5,), (7,)], "id long"), make([(5, None), (7, 7)], "row long, col long")
    assert {r.id: r.group_id for r in linked_groups(spark, v, p).collect()} == {5: 5, 7: 7}
    assert linked_groups(spark, v.limit(0), p.limit(0)).count() == 0
