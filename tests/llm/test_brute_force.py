"""The queries without SQL, over the smallest tables, against plain versions of them."""

from collections import defaultdict
from itertools import combinations

import pytest
from conftest import SMALL

from weftgraph.llm import queries
from weftgraph.llm.leaks import words
from weftgraph.llm.skeleton import folding


@pytest.fixture(scope="module")
def texts(spark):
    read = lambda name, key: {r[key]: r.text for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(key, "text").collect() if r.text is not None}
    return read("documents", "doc_id"), read("eval_item", "item_id")


def test_leaked_items(spark, texts):
    docs, items, n, fold = *texts, queries.P7_WORDS, folding(spark)
    where = defaultdict(set)
    for i, t in items.items():
        w = words(t, fold)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    want = set()
    for d, t in docs.items():
        w = words(t, fold)
        for k in range(len(w) - n + 1):
            want |= {(d, i) for i in where.get(tuple(w[k : k + n]), ())}
    got = [tuple(r) for r in queries.p7_found(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_visually_equal_pairs(spark, texts):
    same, fold = defaultdict(set), folding(spark)
    for d, t in texts[0].items():
        if fold.skeleton(t).strip():
            same[fold.skeleton(t)].add(d)
    want = {(a, b) for ids in same.values() for a, b in combinations(sorted(ids), 2) if texts[0][a] != texts[0][b]}
    got = [tuple(r) for r in queries.p8_found(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.doc_id: r.group_id for r in queries.p8_groups(spark, SMALL).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
