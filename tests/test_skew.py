from collections import Counter
from fractions import Fraction

import pytest

from weftgraph.operators.skew import heavy_keys, keyed_percentiles, keyed_stats, segment_counts


@pytest.fixture(scope="module")
def rows():
    out = [(1, float(i % 7), "a") for i in range(400)] + [(2, 5.0, "b"), (2, None, "b"), (3, None, "c"), (None, 1.0, "d"), (4, -2.0, "e"), (4, 9.0, "e"), (4, 9.0, "e"), (5, 3.0, "f"), (5, 1.0, "f")]
    return out


def test_keyed_stats(make, rows):
    got = {r.key: r for r in keyed_stats(make(rows, "k long, v double, key string"), "k", "v").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k in got:
        values = [v for key, v, _ in rows if key == k and v is not None]
        n = sum(key == k for key, _, _ in rows)
        best = min(Counter(values).items(), key=lambda x: (-x[1], x[0]), default=(None, None))
        assert (got[k].n, got[k].n_value, got[k].n_distinct) == (n, len(values), len(set(values)))
        assert got[k].value_sum == (pytest.approx(sum(values)) if values else None)
        assert (got[k].mode, got[k].mode_n) == best


@pytest.mark.parametrize("parts", [1, 6])
def test_percentiles(make, rows, parts):
    d = make(rows, "k long, v double, key string")
    got = {r.key: (r.p0, r.p1, r.p2) for r in keyed_percentiles(d, "k", "v", ["0.5", "0.9", 1], parts).collect()}
    for k in (1, 2, 4, 5):
        v = sorted(x for key, x, _ in rows if key == k and x is not None)
        assert got[k] == tuple(v[max(0, -(-len(v) * Fraction(s) // 1) - 1)] for s in ("0.5", "0.9", "1"))
    assert set(got) == {1, 2, 4, 5}


def test_heavy_keys(make, rows):
    d = make(rows, "k long, v double, key string")
    assert [r.key for r in heavy_keys(d, "k", "v", "0.01").collect()] == [1]
    exact = make([(i % 4, 1.0) for i in range(8)], "k long, v double")
    assert sorted(r.key for r in heavy_keys(exact, "k", "v", "0.25").collect()) == [0, 1, 2, 3]


def test_nothing(make):
    d = make([], "k long, v double")
    assert keyed_stats(d, "k", "v").count() == heavy_keys(d, "k", "v", "0.1").count() == keyed_percentiles(d, "k", "v", ["0.5"]).count() == 0
    null = make([(None, 1.0)], "k long, v double")
    assert keyed_stats(null, "k", "v").count() == 0


def test_segment_counts(make):
    d = make([(1, 0, 0), (1, 1, 3), (1, 2, 3), (1, 3, 9), (1, 3, 9), (2, 0, 0)], "m long, seg long, csr long")
    assert sorted(tuple(r) for r in segment_counts(d, "m", "seg", "csr").collect()) == [(1, 0, 3), (1, 1, 0), (1, 2, 6)]
