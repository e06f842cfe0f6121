import datetime as dt
import random

import pytest

from weftgraph.operators.orphans import dangling_references, dangling_report


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = set()
    for eid, m, t, r, c in refs:
        for field, x, size in (("row", r, 1), ("col", c, 2)):
            if x is None:
                continue
            has = [p for p in parents if m is not None and p[0] == m and p[size] is not None and 0 <= x < p[size]]
            if t is not None and any(p[3] is not None and p[3] <= t and (p[4] is None or p[4] > t) for p in has):
                continue
            late = t is not None and any(p[3] is not None and p[3] > t for p in has)
            gone = t is not None and any(p[4] is not None and p[4] <= t for p in has)
            out.add((eid, field, "late" if late else "deleted" if gone else "missing"))
    return out


def case(seed, n=400):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.05 else x
    parents = []
    for m in range(20):
        for _ in range(r.randrange(1, 4)):
            a = r.randrange(0, 90)
            parents.append((m * 3, some(r.randrange(1, 12)), some(r.randrange(1, 12)), some(a), some(a + r.randrange(1, 60))))
    parents += parents[:5] + [(None, 5, 5, 0, None)]
    refs = [(i, some(r.choice([0, 0, 0, r.randrange(0, 62)])), some(r.randrange(0, 130)), some(r.randrange(-2, 13)), some(r.randrange(-2, 13))) for i in range(n)]
    return refs + refs[:20], parents


def frames(make, refs, parents):
    d = make([(i, m, day(t), r, c, "x") for i, m, t, r, c in refs], "element_id long, matrix_id long, loaded_at timestamp_ntz, row long, col long, key string")
    p = make([(m, h, w, day(a), day(b), 1) for m, h, w, a, b in parents], "matrix_id long, height long, width long, valid_from timestamp_ntz, valid_to timestamp_ntz, row long")
    return d, p


def find(d, p, **options):
    return dangling_references(d, p, "element_id", "matrix_id", "loaded_at", {"row": "height", "col": "width"}, "matrix_id", "valid_from", "valid_to", **options)


@pytest.mark.parametrize("options", [{}, {"range_rows": 7}, {"broadcast_bytes": 0, "range_rows": 7, "rows_per_salt": 40}, {"broadcast_bytes": 0}])
@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_match_brute_force(make, seed, options):
    refs, parents = case(seed)
    got = [(r.id, r.field, r.reason) for r in find(*frames(make, refs, parents), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(refs, parents)


def test_report(make):
    refs = [(1, 9, 0, 0, None), (2, 9, 40, 1, 2), (2, 9, 40, 1, 2)]
    d, p = frames(make, refs, [(1, 1, 1, 0, None)])
    got = {(r.field, r.month.month, r.reason): r.n for r in dangling_report(find(d, p)).collect()}
    assert got == {("row", 1, "missing"): 1, ("row", 2, "missing"): 1, ("col", 2, "missing"): 1}


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}])
def test_nothing(make, options):
    d, p = frames(make, [(1, 1, 0, 0, 0)], [(1, 1, 1, 0, None)])
    assert find(d.limit(0), p, **options).count() == find(d, p, **options).count() == 0
    assert {(r.field, r.reason) for r in find(d, p.limit(0), **options).collect()} == {("row", "missing"), ("col", "missing")}


def test_a_thousand_ranges_are_planned_at_once(make, spark):
    import time

    parents = [(m, 5, 5, 0, None) for m in range(20_000)]
    refs = [(i, 7 if i % 3 == 0 else i * 9 % 20_500, 5, i % 7, 4) for i in range(3_000)]
    d, p = frames(make, refs, parents)
    found = find(d, p, broadcast_bytes=-1, range_rows=15, rows_per_salt=100)
    began = time.monotonic()
    found._jdf.queryExecution().executedPlan()
    assert time.monotonic() - began < 2
    assert {(r.id, r.field, r.reason) for r in found.collect()} == brute_fast(refs, dict((m, 5) for m, *_ in parents))


def brute_fast(refs, sizes):
    """For one version of each key that has held since day 0."""
    return {(i, f, "missing") for i, m, _, r, c in refs for f, x in (("row", r), ("col", c)) if not 0 <= x < sizes.get(m, 0)}


def test_versions_that_meet_or_overlap(make):
    parents = [(1, 4, 4, 0, 10), (1, 2, 2, 10, 20), (1, 9, 9, 20, None), (2, 4, 4, 0, 10), (2, 8, 8, 5, 7), (2, 3, 3, 5, None), (3, 5, 5, 3, 3)]
    refs = [(k * 100 + t * 10 + x, k, t, x, x) for k in (1, 2, 3) for t in (-1, 0, 3, 5, 6, 7, 9, 10, 15, 20, 30) for x in (0, 2, 3, 7, 8)]
    for options in ({}, {"broadcast_bytes": -1, "range_rows": 2}):
        assert {(r.id, r.field, r.reason) for r in find(*frames(make, refs, parents), **options).collect()} == brute(refs, parents)
