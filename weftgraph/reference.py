"""Plain single-threaded versions of the algorithms, for ``run_CPU``: a check by hand of one result.

The whole graph comes to the driver, so graphs beyond a bound are refused; nothing else uses this.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from math import sqrt

from weftgraph.model import Graph

MOST_EDGES = 2_000_000


def _edges(graph: Graph) -> tuple[list[int], dict[int, list[tuple[int, float]]]]:
    n = graph.edges.count()
    if n > MOST_EDGES:
        raise ValueError(f"run_CPU takes at most {MOST_EDGES} edges, not {n}")
    near = defaultdict(list)
    for r in graph.edges.toLocalIterator():
        near[r.src].append((r.dst, r.w))
    return sorted(r.id for r in graph.vertices.toLocalIterator()), near


def levels(graph: Graph, source: int) -> dict[int, int]:
    ids, near = _edges(graph)
    out, todo = dict.fromkeys(ids, -1), deque()
    if source in out:
        out[source] = 0
        todo.append(source)
    while todo:
        v = todo.popleft()
        for u, _ in near[v]:
            if out[u] < 0:
                out[u] = out[v] + 1
                todo.append(u)
    return out


def distances(graph: Graph, source: int, unreached: int) -> dict[int, float]:
    """By a heap; a vertex is taken again whenever its distance falls, so weights below 0 do no harm unless they form a cycle."""
    ids, near = _edges(graph)
    out = dict.fromkeys(ids, unreached)
    heap = [(0, source)] if source in out else []
    if heap:
        out[source] = 0
    while heap:
        d, v = heapq.heappop(heap)
        if d > out[v]:
            continue
        for u, w in near[v]:
            if d + w < out[u]:
                out[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return out


def labels(graph: Graph) -> dict[int, int]:
    ids, near = _edges(graph.both_ways())
    out: dict[int, int] = {}
    for v in ids:
        todo = [] if v in out else [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo.extend(u for u, _ in near[x])
    return out


def ranks(graph: Graph, damping: float, change_tol: float) -> dict[int, float]:
    """All vertices in rounds, until none moves by ``change_tol`` or more."""
    ids, near = _edges(graph)
    out = dict.fromkeys(ids, 1 - damping)
    while True:
        got: dict[int, float] = defaultdict(float)
        for v, es in near.items():
            for u, _ in es:
                got[u] += out[v] / len(es)
        new = {v: 1 - damping + damping * got[v] for v in ids}
        moved = max((abs(new[v] - out[v]) for v in ids), default=0.0)
        out = new
        if moved < change_tol:
            return out


def compared(got: dict[int, float], want: dict[int, float], tol: float | None = None) -> str:
    """How a result compares: the number of different values, or with ``tol`` the relative L2 error and whether it passes."""
    if tol is None:
        return f"CPU: {sum(got.get(v) != x for v, x in want.items())} of {len(want)} values differ"
    error = sqrt(sum((got[v] - x) ** 2 for v, x in want.items())) / (sqrt(sum(x * x for x in want.values())) or 1.0)
    return f"CPU: relative L2 error {error:.6f}, {'pass' if error <= tol else 'fail'} at {tol}"
