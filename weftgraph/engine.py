"""The superstep loop.

Edges are written once, bucketed by the vertex they are taken from, with the edges of hubs
apart (``Layout``).  Vertex state is a bucketed table and a few deltas.  Each superstep has one
of two plans, chosen by the size of its frontier:

* dense: messages of all changed vertices meet state in a bucketed join, which writes the state
  anew; only combined messages are shuffled.  What vertices gather for the next superstep
  travels with the messages;
* sparse: only the frontier's edges are joined, only the state of vertices that got a message
  is looked up, and only those that changed are written, as a delta.  Deltas are merged from
  time to time.

Both give the same rows.  The number of active vertices is observed while state is written, so
it costs no job.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.program import COMBINE, Along, Program
from weftgraph.session import Workspace, buckets_for

#: A superstep is sparse where its frontier, times the mean degree, is below 1 / SPARSE of the vertices,
#: and the graph has more than PASS_ROWS vertices and edges: a pass over fewer costs less than the
#: sparse plan's additional stages.
SPARSE = 8
PASS_ROWS = 2_000_000
#: So many deltas are merged into one.
DELTAS = 6
REVERSE = {Along.OUT: Along.IN, Along.IN: Along.OUT, Along.ALL: Along.ALL}


@dataclass
class Report:
    """What a run did: for each superstep its number, plan, active vertices and seconds, in ``setup`` the seconds before the first."""

    supersteps: list[dict] = field(default_factory=list)
    converged: bool = False
    setup: float = 0.0
    hubs: int = 0


def incident(edges: DataFrame, along: Along) -> DataFrame:
    """(v, u, w): each edge seen from the vertex ``v`` that owns it; u is at its other end."""
    out = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w")
    into = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), "w")
    return {Along.OUT: lambda: out, Along.IN: lambda: into, Along.ALL: lambda: out.unionByName(into)}[along]()


class Layout:
    """Edges seen from one end, written once for many joins with vertices.

    Edges are bucketed by their vertex, so joins never move them.  A vertex with more than
    1 / (4 * buckets) of all edges is a hub; there are fewer than 4 * buckets of those.  Their
    edges are spread evenly, whichever hub they belong to, and meet the hubs' rows, which are
    few by that bound, by broadcast.
    """

    def __init__(self, ws: Workspace, edges: DataFrame, along: Along, size: int) -> None:
        self.size = size * (2 if along is Along.ALL else 1)
        self.buckets, self.heavy = buckets_for(ws.spark, self.size), None
        e, seen = incident(edges, along), Observation()
        tasks = max(1, self.buckets)
        counts = e.groupBy("v").agg(F.count("*").alias("d")).filter(F.col("d") * (4 * tasks) > self.size)
        hubs = ws.keep(counts.select("v").observe(seen, F.count(F.lit(1)).alias("n")), "hubs")
        self.n_hubs, self.hubs = seen.get["n"], F.broadcast(hubs)
        light = e
        if self.n_hubs:
            self.heavy = ws.keep(e.join(self.hubs, "v", "left_semi").repartition(tasks, "u"), "heavy")
            light = e.join(self.hubs, "v", "left_anti")
        self.light = ws.keep(light, "edges", "v", self.buckets, place=True, ordered=True)

    def join(self, rows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
        """(v, columns of rows, u, w): each edge of the ids of ``rows``, with their columns.  Where
        all ids are known to lie from ``low`` to ``high``, other parts of the sorted files are not read."""
        r = rows.withColumnRenamed("id", "v")
        light = self.light if low is None else self.light.filter(F.col("v").between(low, high))
        out = r.join(light, "v")
        if self.heavy is not None:
            out = out.unionByName(self.heavy.join(F.broadcast(r.join(self.hubs, "v", "left_semi")), "v"))
        return out


def gather(active: DataFrame, state: DataFrame, edges: DataFrame | Layout, along: Along, edge_value, combine: str, identity: object) -> DataFrame:  # noqa: ANN001
    """(id, gathered): ``edge_value`` over the edges of each active id, with the state of the
    vertex at the other end; ``identity`` for vertices without such edges."""
    ids = active.select("id")
    mine = edges.join(ids) if isinstance(edges, Layout) else ids.withColumnRenamed("id", "v").join(incident(edges, along), "v")
    got = mine.join(state.withColumnRenamed("id", "u"), "u").groupBy("v").agg(COMBINE[combine](edge_value(F.col, F.col)).alias("gathered")).withColumnRenamed("v", "id")
    return ids.join(got, "id", "left").select("id", F.coalesce("gathered", F.lit(identity)).alias("gathered"))


def expand(active: DataFrame, edges: DataFrame | Layout, along: Along, message, combine: str, keep=None) -> DataFrame:  # noqa: ANN001
    """(id, msg): the messages along the edges of the active rows, combined where they meet;
    ``keep(state, edge)`` leaves out edges for which it is not true."""
    sent = edges.join(active) if isinstance(edges, Layout) else active.withColumnRenamed("id", "v").join(incident(edges, along), "v")
    if keep:
        sent = sent.filter(keep(F.col, F.col))
    return sent.select(F.col("u").alias("id"), message(F.col, F.col).alias("msg")).groupBy("id").agg(COMBINE[combine]("msg").alias("msg"))


class _Run:
    """State of one run: ``base`` (id, state, active, msg), and deltas of the same columns, the later ones above the earlier."""

    def __init__(self, ws: Workspace, graph: Graph, program: Program, report: Report, pass_rows: int | None) -> None:
        self.ws, self.program, self.report, self.pass_rows = ws, program, report, PASS_ROWS if pass_rows is None else pass_rows
        seen = Observation()
        edges = ws.keep(graph.edges.observe(seen, F.count(F.lit(1)).alias("n")), "graph")
        self.graph, self.edges = Graph(graph.vertices, edges), seen.get["n"]
        self.layouts: dict[Along, Layout] = {}
        self.message = program.expand_edge or (lambda s, e: F.lit(1).cast(program.message_type))
        self.gathers = program.gather is not Along.NONE
        self.base, self.deltas, self.has_got, self.low, self.high, self.active = None, [], False, None, None, 0

    def layout(self, along: Along) -> Layout:
        if along not in self.layouts:
            self.layouts[along] = Layout(self.ws, self.graph.edges, along, self.edges)
            self.report.hubs = max(self.report.hubs, self.layouts[along].n_hubs)
        return self.layouts[along]

    def start(self, sources: DataFrame | None) -> None:
        p, base, is_source = self.program, self.graph.vertices, F.lit(True)
        if p.sources_only:
            marked = sources.select(F.col("id").cast("bigint").alias("id")).distinct().withColumn("_source", F.lit(True))
            base, is_source = base.join(marked, "id", "left"), F.coalesce("_source", F.lit(False))
        if "degree" in p.extra:
            base = base.join(p.extra["degree"](self.graph), "id", "left")
        init = p.init(F.col("id"), is_source)
        self.names = list(init)
        self.buckets = self.layout(p.expand).buckets
        first = base.select("id", *(c.alias(k) for k, c in init.items()), is_source.alias("active"), F.lit(None).cast(p.message_type).alias("msg"))
        self._write_base(first, place=True)

    def _observed(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        seen, own = Observation(), F.when(F.col("active"), F.col("id"))
        return df.observe(seen, F.count(F.lit(1)).alias("n"), F.count(own).alias("active"), F.min(own).alias("low"), F.max(own).alias("high")), seen

    def _note(self, seen: Observation) -> int:
        got = seen.get
        self.active, self.low, self.high = got["active"], got["low"], got["high"]
        return got["n"]

    def _write_base(self, df: DataFrame, place: bool = False) -> None:
        out, seen = self._observed(df)
        new = self.ws.keep(out, "vertices", "id", self.buckets, place)
        self.ws.drop(self.base, *(d for d, _ in self.deltas))
        self.base, self.deltas, self.n = new, [], self._note(seen)
        self.has_got = "got" in df.columns

    def _versions(self) -> DataFrame:
        """(id, ver, state columns): all rows of state, the current one of each id having the largest ver."""
        out = self.base.select("id", F.lit(0).alias("ver"), *self.names)
        for k, (d, _) in enumerate(self.deltas):
            out = out.union(d.select("id", F.lit(k + 1).alias("ver"), *self.names))
        return out

    def state_of(self, ids: DataFrame) -> DataFrame:
        """(id, state columns) of the given ids."""
        s = self._versions().join(ids, "id", "left_semi")
        if not self.deltas:
            return s.drop("ver")
        return s.groupBy("id").agg(F.max_by(F.struct(*self.names), "ver").alias("s")).select("id", "s.*")

    def current(self) -> DataFrame:
        """(id, state columns, active, msg) of all vertices."""
        if not self.deltas:
            return self.base.select("id", *self.names, "active", "msg")
        latest = self._latest([d for d, _ in self.deltas])
        new, last = F.col("s").isNotNull(), F.col("ver") == len(self.deltas) - 1
        both = self.base.join(latest, "id", "left")
        kept = [F.when(new, F.col(f"s.{k}")).otherwise(F.col(k)).alias(k) for k in self.names]
        return both.select("id", *kept, F.coalesce(last & F.col("s.active"), F.lit(False)).alias("active"), F.when(last, F.col("s.msg")).alias("msg"))

    def _latest(self, deltas: list[DataFrame]) -> DataFrame:
        """(id, s, ver): the last row of each id in the deltas."""
        rows = None
        for k, d in enumerate(deltas):
            one = d.select("id", F.lit(k).alias("ver"), *self.names, "active", "msg")
            rows = one if rows is None else rows.union(one)
        return rows.groupBy("id").agg(F.max_by(F.struct(*self.names, "active", "msg"), "ver").alias("s"), F.max("ver").alias("ver"))

    def _merge(self) -> None:
        """The deltas but the last become one, or part of the base where they are large."""
        if sum(n for _, n in self.deltas) * 2 > self.n:
            self._write_base(self.current())
            return
        old, last = self.deltas[:-1], self.deltas[-1]
        seen = Observation()
        one = self._latest([d for d, _ in old]).select("id", "s.*").observe(seen, F.count(F.lit(1)).alias("n"))
        self.deltas = [(self.ws.keep(one, "delta"), seen.get["n"]), last]
        self.ws.drop(*(d for d, _ in old))

    def _apply(self, rows: DataFrame, arrived, step: int, active) -> DataFrame:  # noqa: ANN001
        """(id, state columns, changed) after the program's apply on active rows."""
        p, new, changed = self.program, {}, active
        if p.apply:
            new = p.apply(F.col, arrived, step)
            changed = active & F.coalesce(p.changed(F.col, new, arrived, step), F.lit(False))
        state = [F.when(active, new[k]).otherwise(F.col(k)).alias(k) if k in new else F.col(k) for k in self.names]
        out = rows.select("id", *state, changed.alias("changed"))
        return out.withColumn("changed", F.col("changed") & F.coalesce(p.expand_vertex(F.col, step), F.lit(False))) if p.expand_vertex else out

    def _met(self, step: int, *more) -> list:  # noqa: ANN002
        """Columns of state after the messages were contracted."""
        p, accept = self.program, F.col("msg").isNotNull()
        if p.accept:
            accept &= F.coalesce(p.accept(F.col, F.col("msg")), F.lit(False))
        set_ = p.contract(F.col, F.col("msg"), step) if p.contract else {}
        state = [F.when(accept, set_[k]).otherwise(F.col(k)).alias(k) if k in set_ else F.col(k) for k in self.names]
        return ["id", *state, accept.alias("active"), F.when(accept, F.col("msg")).alias("msg"), *more]

    def _pushed(self, now: DataFrame, messages: bool) -> DataFrame:
        """(id, got, msg): what vertices gather from all of ``now``, and the messages of changed ones, in one pass where edges allow."""
        p, back = self.program, REVERSE[self.program.gather]
        kept = p.keep_edge(F.col, F.col) if p.keep_edge else F.lit(True)
        msg = F.when(F.col("changed") & kept, self.message(F.col, F.col)).alias("msg") if messages else F.lit(None).cast(p.message_type).alias("msg")
        given = p.gather_edge(F.col, F.col).alias("got")
        sent = self.layout(back).join(now)
        if back is p.expand or not messages:
            sent = sent.select(F.col("u").alias("id"), given, msg)
        else:
            other = self.layout(p.expand).join(now.filter("changed")).select(F.col("u").alias("id"), msg)
            sent = sent.select(F.col("u").alias("id"), given).unionByName(other, allowMissingColumns=True)
        return sent.groupBy("id").agg(COMBINE[p.gather_sum]("got").alias("got"), COMBINE[p.combine]("msg").alias("msg"))

    def dense(self, step: int) -> None:
        p = self.program
        if self.deltas:
            self._write_base(self.current())
        identity = F.lit(p.gather_identity)
        if self.gathers and not self.has_got:
            v = self.base.withColumn("changed", F.lit(False))
            self._write_base(self.base.join(self._pushed(v.select("id", *self.names, "changed"), False).drop("msg"), "id", "left").select("id", *self.names, "active", "msg", F.coalesce("got", identity).alias("got")))
        now = self._apply(self.base, F.col("got" if self.gathers else "msg"), step, F.col("active"))
        if self.gathers:
            msgs, more = self._pushed(now, True), [F.coalesce("got", identity).alias("got")]
        else:
            msgs, more = expand(now.filter("changed").select("id", *self.names), self.layout(p.expand), p.expand, self.message, p.combine, p.keep_edge), []
        self._write_base(now.select("id", *self.names).join(msgs, "id", "left").select(*self._met(step, *more)))

    def sparse(self, step: int) -> None:
        p = self.program
        front, made = (self.deltas[-1][0] if self.deltas else self.base).filter("active"), None
        if self.gathers:
            if self.deltas or not self.has_got:
                near = self.layout(p.gather).join(front.select("id"), self.low, self.high)
                state = self.state_of(near.select(F.col("u").alias("id")).distinct()).withColumnRenamed("id", "u")
                got = near.join(state, "u").groupBy(F.col("v").alias("id")).agg(COMBINE[p.gather_sum](p.gather_edge(F.col, F.col)).alias("got"))
                front = front.join(got, "id", "left").select(front["*"], F.coalesce("got", F.lit(p.gather_identity)).alias("got"))
            made = self.ws.keep(self._apply(front, F.col("got"), step, F.lit(True)), "applied")
        own = made if made is not None else self._apply(front, F.col("msg"), step, F.lit(True))
        sent = self.layout(p.expand).join(own.filter("changed").select("id", *self.names), self.low, self.high)
        if p.keep_edge:
            sent = sent.filter(p.keep_edge(F.col, F.col))
        msgs = sent.select(F.col("u").alias("id"), self.message(F.col, F.col).alias("msg")).groupBy("id").agg(COMBINE[p.combine]("msg").alias("msg"))
        top = len(self.deltas) + 1
        rows = self._versions().join(msgs.select("id"), "id", "left_semi").union(own.select("id", F.lit(top).alias("ver"), *self.names))
        rows = rows.unionByName(msgs, allowMissingColumns=True)
        each = rows.groupBy("id").agg(F.max_by(F.struct(*self.names), "ver").alias("s"), F.max("msg").alias("msg"), (F.max("ver") == top).alias("own"))
        after = each.select("id", "s.*", "msg", "own").select(*self._met(step, "own")).filter("own OR active").drop("own")
        out, seen = self._observed(after)
        delta = self.ws.keep(out, "delta")
        self.ws.drop(made)
        self.deltas.append((delta, self._note(seen)))
        if len(self.deltas) > DELTAS:
            self._merge()

    def step(self, k: int) -> str:
        size = self.layout(self.program.expand).size
        few = self.n + size > self.pass_rows and self.active * max(1.0, size / max(1, self.n)) * SPARSE < self.n
        (self.sparse if few else self.dense)(k)
        return "sparse" if few else "dense"


def run(graph: Graph, program: Program, sources: DataFrame | None = None, iter_num: int | None = None, max_supersteps: int | None = None, report: Report | None = None, pass_rows: int | None = None) -> DataFrame:
    """(id, state columns): run until no vertex is active, or for ``iter_num`` supersteps.

    ``sources`` holds the ids that start active, unless the program starts with all.  Ids not
    in the graph are ignored.  Where ``iter_num`` is not given, more than ``max_supersteps``
    (default: vertices + 1) raise RuntimeError: the program does not end on this graph.
    Supersteps of graphs of up to ``pass_rows`` vertices and edges are all dense.
    """
    began, report = time.monotonic(), report if report is not None else Report()
    r = _Run(Workspace(graph.vertices.sparkSession), graph, program, report, pass_rows)
    r.start(sources)
    report.setup = round(time.monotonic() - began, 3)
    limit = max_supersteps if max_supersteps is not None else program.max_supersteps or r.n + 1
    step = 0
    while r.active and (iter_num is None or step < iter_num):
        if iter_num is None and step >= limit:
            raise RuntimeError(f"still {r.active} active vertices after {step} supersteps; a negative cycle never ends")
        began, active = time.monotonic(), r.active
        plan = r.step(step)
        report.supersteps.append({"superstep": step, "plan": plan, "active": active, "seconds": round(time.monotonic() - began, 3)})
        step += 1
    report.converged = not r.active
    return r.current().select("id", *r.names)
