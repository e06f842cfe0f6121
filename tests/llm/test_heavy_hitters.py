from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.heavy_hitters import Summary, frequent_items


@given(st.lists(st.lists(st.integers(0, 40), max_size=80), min_size=1, max_size=8), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_bounds_hold_for_any_tree_of_merges(parts, k):
    nodes = []
    for p in parts:
        s = Summary(pa.int64(), k)
        s.total = len(p)
        s.add(pa.array(p, pa.int64()))
        nodes.append(s)
    while len(nodes) > 1:
        a, b = nodes.pop(0), nodes.pop(0)
        a.total, a.floor = a.total + b.total, a.floor + b.floor
        a.add(b.values, b.counts)
        nodes.append(a)
    true, root = Counter(x for p in parts for x in p), nodes[0]
    got = dict(zip(root.values.to_pylist(), root.counts.tolist()))
    assert len(got) <= k and root.floor * (k + 1) <= root.total
    for x, n in true.items():
        assert got.get(x, 0) <= n <= got.get(x, 0) + root.floor


@pytest.mark.parametrize("parts", [1, 5])
def test_frequent_items(make, parts):
    r = np.random.default_rng(1)
    values = [int(x) for x in r.zipf(1.3, 6000) % 5000] + [None] * 500
    d = make([(v, "x", 1) for v in values], "v long, item string, n long").repartition(parts)
    true = Counter(v for v in values if v is not None)
    got = frequent_items(d, "v", "0.01").collect()
    assert {x["item"]: x["n"] for x in got} == {v: n for v, n in true.items() if n * 100 >= 6000}
    assert all(x["lower"] <= x["n"] <= x["upper"] for x in got)


def test_ties_at_the_limit_stay(make):
    d = make([(i % 10,) for i in range(100)], "v long")
    assert frequent_items(d, "v", Fraction(1, 10)).count() == 10


def test_text_values_and_nothing(make):
    d = make([("a",), ("a",), ("",), (None,)], "v string")
    assert {x["item"]: x["n"] for x in frequent_items(d, "v", "0.3").collect()} == {"a": 2, "": 1}
    assert frequent_items(d.filter("v IS NULL"), "v", "0.3").count() == 0
    assert frequent_items(d.limit(0), "v", "0.3").count() == 0
