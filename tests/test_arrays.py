import bisect
import random
from collections import Counter
from itertools import accumulate, groupby

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import elementwise
from weftgraph.operators import hot, order, relational, scan


@pytest.fixture(scope="module")
def keys():
    r = random.Random(5)
    return [r.randrange(8) for _ in range(120)]


@pytest.fixture(scope="module")
def arr(make):
    return lambda xs, name="key": make([(i, x) for i, x in enumerate(xs)], f"pos long, {name} long")


def col(df, name, *by):
    return [r[name] for r in df.orderBy(*by).collect()]


def test_removal_and_insertion(make, arr):
    r = random.Random(11)
    values, gone = [r.randrange(50) for _ in range(40)], sorted(r.sample(range(40), 13))
    kept = order.bulk_remove(arr(values, "val"), "pos", make([(x,) for x in gone], "pos long"))
    assert col(kept, "val", "new_pos") == [v for i, v in enumerate(values) if i not in gone]
    places = sorted(r.randrange(41) for _ in range(9))
    got = order.bulk_insert(make([(i, at, -i) for i, at in enumerate(places)], "pos long, at long, val long"), arr(values, "val"))
    want = list(values)
    for i, at in reversed(list(enumerate(places))):
        want.insert(at, -i)
    assert col(got, "val", "new_pos") == want


@pytest.mark.parametrize("block", [3, 65_536])
def test_repetition_in_blocks(make, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", block)
    counts = [4, 0, 11, 1, 0, 6]
    d = make([(i, 10 * i, n) for i, n in enumerate(counts)], "pos long, val long, n int")
    owners = [i for i, n in enumerate(counts) for _ in range(n)]
    assert col(order.load_balance(d, "pos", "n"), "owner", "item") == owners
    assert col(order.load_balance(d, "pos", "n"), "rank", "item") == [k for n in counts for k in range(n)]
    assert col(order.interval_expand(d, "pos", "n", "val"), "value", "item") == [10 * i for i in owners]


def test_join_by_position(arr):
    a, b = [7, 9, 4, 4, 1], [4, 7, 7, 2]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y} | {(1, -1), (4, -1), (-1, 3)}
    assert {(r.a_pos, r.b_pos) for r in relational.relational_join(arr(a), arr(b), "full").collect()} == want


def test_multisets(arr):
    a, b = [1, 1, 1, 2, 3], [1, 2, 2, 4]
    x, y = arr(a).select("key"), arr(b).select("key")
    get = lambda d: sorted(r.key for r in d.collect())
    assert get(relational.intersection(x, y)) == [1, 2]
    assert get(relational.union(x, y)) == [1, 1, 1, 2, 2, 3, 4]
    assert get(relational.difference(x, y)) == [1, 1, 3]
    assert get(relational.symmetric_difference(x, y)) == [1, 1, 2, 3, 4]
    assert get(relational.set_operation(x.distinct(), y.distinct(), "symmetric_difference")) == [3, 4]
    pairs = relational.paired_sets(arr(a), arr(b), "symmetric_difference").collect()
    assert sorted((r.key, r.side, r.pos) for r in pairs) == [(1, "a", 1), (1, "a", 2), (2, "b", 2), (3, "a", 4), (4, "b", 3)]


def test_multisets_match_counters(arr, keys):
    a, b = keys[:70], keys[70:]
    m, n = Counter(a), Counter(b)
    got = Counter(r.key for r in relational.union(arr(a).select("key"), arr(b).select("key")).collect())
    assert got == m | n


def test_runs_are_not_groups(make):
    d = make([(i, k, i + 1) for i, k in enumerate("aabaaa")], "pos long, key string, val long")
    assert [(r.key, r.value) for r in order.reduce_by_run(d, "pos", "key", F.sum("val")).orderBy("run").collect()] == [("a", 3), ("b", 3), ("a", 15)]


def test_runs_match_groupby(arr, keys):
    got = [(r.key, r.value) for r in order.reduce_by_run(arr(keys), "pos", "key", F.count("*")).orderBy("run").collect()]
    assert got == [(k, len(list(g))) for k, g in groupby(keys)]
    assert col(order.consecutive_removal(arr(keys), "pos", "key"), "key", "pos") == [k for k, _ in groupby(keys)]


def test_null_keys_form_runs(make):
    d = make([(0, None), (1, None), (2, 1), (3, None)], "pos long, key long")
    assert col(order.consecutive_removal(d, "pos", "key"), "pos", "pos") == [0, 2, 3]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_scans(arr, keys, parts):
    d = arr(keys, "val")
    assert col(scan.scan(d, "pos", "val", parts=parts), "scan", "pos") == list(accumulate(keys))
    assert col(scan.scan(d, "pos", "val", inclusive=False, parts=parts), "scan", "pos") == [0, *accumulate(keys)][:-1]
    assert col(scan.scan(d, "pos", "val", "max", parts=parts), "scan", "pos") == list(accumulate(keys, max))


def test_segmented_scan_with_a_hot_segment(make, keys):
    rows = [(i, None if i == 5 else 0 if i % 3 else i % 7, k) for i, k in enumerate(keys)]
    got = {r.pos: r.scan for r in scan.scan(make(rows, "pos long, seg long, val long"), "pos", "val", seg="seg", parts=5).collect()}
    total = Counter()
    for pos, seg, v in rows:
        total[seg] += v
        assert got[pos] == total[seg]


def test_scan_of_nulls_and_of_nothing(make):
    d = make([(0, None), (1, 4), (2, None), (3, 5)], "pos long, val long")
    assert col(scan.scan(d, "pos", "val"), "scan", "pos") == [0, 4, 4, 9]
    assert scan.scan(d.limit(0), "pos", "val").count() == 0
    assert col(scan.max_scan(d, "pos", "val"), "scan", "pos") == [None, 4, 4, 5]


def test_difference_and_flags(arr, keys):
    assert col(order.adjacent_difference(arr(keys, "val"), "pos", "val"), "diff", "pos") == [keys[0]] + [b - a for a, b in zip(keys, keys[1:])]
    d = arr(keys).withColumn("f", F.col("key") == 3)
    assert col(scan.segments_from_flags(d, "pos", "f"), "seg", "pos") == list(accumulate(int(k == 3) for k in keys))


def test_sorts_are_stable(arr, keys):
    d = arr(keys)
    want = sorted(range(len(keys)), key=lambda i: keys[i])
    assert col(order.sort_keys(d, "key", "pos"), "pos", "rank") == want
    assert col(order.radix_sort(d, "key", "pos", 1, 3), "pos", "rank") == sorted(range(len(keys)), key=lambda i: keys[i] >> 1 & 3)
    signed = arr([3, -1, 0, -9])
    assert col(order.radix_sort(signed, "key", "pos"), "key", "rank") == [0, 3, -9, -1]


def test_segmented_sort_from_starts(make, arr, keys):
    starts = [0, 5, 6, 30, 64, 100, 118]
    seg = order.segments_from_starts(arr(keys), "pos", make([(s,) for s in starts], "start long"))
    got = [(r.seg, r.key) for r in order.segmented_sort(seg, "seg", "key", "pos").orderBy("seg", "rank").collect()]
    want = [(i, k) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(keys)])) for k in sorted(keys[a:b])]
    assert got == want


def test_merge_and_search(arr, keys):
    a, b = sorted(keys[:50]), sorted(keys[50:])
    merged = order.merge(arr(a), arr(b)).orderBy("new_pos").collect()
    assert [r.key for r in merged] == sorted(a + b)
    assert all((x.side, y.side) != ("b", "a") for x, y in zip(merged, merged[1:]) if x.key == y.key)
    assert col(order.sorted_search(arr(a), arr(b)), "index", "pos") == [bisect.bisect_left(b, k) for k in a]
    assert col(order.sorted_search(arr(a), arr(b), upper=True), "index", "pos") == [bisect.bisect_right(b, k) for k in a]
    assert col(order.equality_count(arr(a), arr(b)), "n", "pos") == [b.count(k) for k in a]
    assert col(order.search_match(arr(a), arr(b)), "match", "pos") == [k in b for k in a]


def test_other_orders(arr, keys):
    down = lambda c: c.desc()
    by_rest = lambda c: c % 3
    assert col(order.sort_keys(arr(keys), "key", "pos", order=down), "pos", "rank") == sorted(range(len(keys)), key=lambda i: -keys[i])
    assert col(order.sort_keys(arr(keys), "key", "pos", order=by_rest), "pos", "rank") == sorted(range(len(keys)), key=lambda i: keys[i] % 3)
    a, b = sorted(keys[:50], reverse=True), sorted(keys[50:], reverse=True)
    assert col(order.merge(arr(a), arr(b), order=down), "key", "new_pos") == sorted(a + b, reverse=True)
    assert col(order.sorted_search(arr(a), arr(b), order=down), "index", "pos") == [sum(x > k for x in b) for k in a]


@pytest.mark.parametrize("upper", [False, True])
def test_search_of_both_sides(arr, keys, upper):
    a, b = sorted(k * 2 for k in keys[:30]), sorted(keys[30:90])
    got = {(r.side, r.pos): (r["index"], r.match) for r in order.search_both(arr(a), arr(b), upper).collect()}
    left, right = (bisect.bisect_right, bisect.bisect_left) if upper else (bisect.bisect_left, bisect.bisect_right)
    want = {("a", i): (left(b, k), k in b) for i, k in enumerate(a)} | {("b", i): (right(a, k), k in a) for i, k in enumerate(b)}
    assert got == want
    assert order.match_counts(arr(a), arr(b)).first()[:] == (sum(k in b for k in a), sum(k in a for k in b))
    # The indices describe one merged order.
    assert {i + got["a", i][0] for i in range(30)} | {i + got["b", i][0] for i in range(60)} == set(range(90))


def test_other_reductions_and_totals(arr, keys):
    product = (F.product, lambda a, b: a * b)
    d = arr([k % 3 + 1 for k in keys[:20]], "val")
    want = list(accumulate([k % 3 + 1 for k in keys[:20]], lambda a, b: a * b))
    rows, total = scan.scan_with_total(d, "pos", "val", product, identity=1.0)
    assert col(rows, "scan", "pos") == want and total.first().total == want[-1]
    assert scan.scan_with_total(d.limit(0), "pos", "val", product, identity=1.0)[1].first().total == 1.0
    assert relational.reduce_with(d, "val", F.product, 1.0).first().value == want[-1] and relational.reduce_with(d.limit(0), "val", F.max, -7).first().value == -7


def test_interval_moves(make, arr):
    src = arr(range(100, 120), "val")
    moves = make([(0, 5, 0, 2), (1, 10, 7, 0), (2, 0, 4, 3)], "pos long, gather long, scatter long, count long")
    get = lambda **k: sorted(tuple(r) for r in order.interval_move(moves, src, **k).collect())
    assert get() == [(0, 105), (1, 106), (4, 100), (5, 101), (6, 102)]
    assert get(scatter=False) == [(0, 105), (1, 106), (2, 100), (3, 101), (4, 102)]
    assert get(gather=False) == [(0, 100), (1, 101), (4, 102), (5, 103), (6, 104)]


def test_moves_by_index(make):
    d = make([(0, 2, 10), (1, 2, 11), (2, 0, 12)], "pos long, at long, val long")
    assert sorted(tuple(r) for r in order.scatter_values(d).collect()) == [(0, 12), (2, 11)]
    assert sorted(tuple(r) for r in order.gather_values(d, d).collect()) == [(0, 12), (1, 12), (2, 10)]


def test_segments_and_products(make):
    data = make([(1, 2), (1, 3), (3, 4)], "seg long, val long")
    segs = make([(1, 3), (2, 1), (3, 9)], "seg long, source long")
    assert sorted(tuple(r) for r in relational.segmented_reduce(data, segs, "seg", F.sum("val"), 0).collect()) == [(1, 5), (2, 0), (3, 4)]
    assert sorted(tuple(r) for r in relational.indirect_reduce(data, segs, "seg", "source", F.sum("val"), 0).collect()) == [(1, 4), (2, 5), (3, 0)]
    m = make([(0, 0, 1.0), (0, 1, 2.0), (0, 1, 3.0), (2, 0, 4.0)], "row long, col long, value double")
    x = make([(0, 10.0), (1, 100.0)], "col long, x double")
    rows = make([(0,), (1,), (2,)], "row long")
    assert sorted(tuple(r) for r in relational.spmv(m, x, rows).collect()) == [(0, 510.0), (1, 0.0), (2, 40.0)]
    assert sorted(tuple(r) for r in relational.spmv(m, x, semiring=relational.MIN_PLUS).collect()) == [(0, 11.0), (2, 14.0)]
    assert sorted(tuple(r) for r in relational.spgemm(m, m).collect()) == [(0, 0, 1.0, 1), (0, 1, 5.0, 2), (2, 0, 4.0, 1), (2, 1, 20.0, 2)]
    assert relational.products(m, m).first()[0] == 6
    p = relational.PreparedMatrix(m)
    assert p.layout.n_hubs and sorted(tuple(r) for r in p.apply(x, rows).collect()) == [(0, 510.0), (1, 0.0), (2, 40.0)]
    assert sorted(tuple(r) for r in p.apply(x, semiring=relational.MIN_PLUS).collect()) == [(0, 11.0), (2, 14.0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_joins_are_joins(make, how):
    r = random.Random(4)
    big = [(7 if r.random() < 0.4 else r.randrange(30), i) for i in range(400)] + [(None, 400)]
    small = [(k, k * 10) for k in range(0, 30, 2)] + [(7, 70), (7, 71)]
    b, s = make(big, "k long, i long"), make(small, "k long, x long")
    want = sorted(map(tuple, b.join(s, "k", how).collect()), key=str)
    for options in ({}, {"task_rows": 0}, {"task_rows": 0, "share": 5}):
        assert sorted(map(tuple, hot.spread_join(b, s, "k", "i", 401, how, **options).collect()), key=str) == want


def test_elementwise(make):
    d = make([(-7, 3)], "a long, b long")
    got = {o: elementwise.transform(d, "a", "b", o).first().value for o in ("plus", "modulus", "maximum", "bit_and", "less")}
    assert got == {"plus": -4, "modulus": -1, "maximum": 3, "bit_and": -7 & 3, "less": True}
    with pytest.raises(Exception, match="(?i)overflow"):
        elementwise.transform(make([(2**63 - 1, 1)], "a long, b long"), "a", "b", "plus").collect()


def test_clashing_and_extra_columns(make):
    d = make([(0, 3, "x", 1), (1, 1, "y", 2)], "pos long, key long, rank string, seg long")
    assert order.sort_keys(d, "key", "pos", to="place").orderBy("place").first().rank == "y"
    assert set(order.number_rows(d, ["key"], "pos").columns) == {"pos", "key", "rank", "seg"}
