"""Queries of the graph algorithms, the superstep operators and graph statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import stats
from weftgraph.algorithms.components import components
from weftgraph.algorithms.pagerank import pagerank, pagerank_delta, pagerank_fixed
from weftgraph.algorithms.traversal import bfs, per_source, predecessors, sssp, sssp_pull
from weftgraph.engine import expand, gather
from weftgraph.plans.graphs import BIP, CO, CO_BOTH, EV, HUB, TREE, bipartite, copurchase, event_chains, hub, tree
from weftgraph.program import Along

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function of (spark, directory) and the SQL that must give the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bfs_sql(edges: str = "g", most: int | None = None, source: int = 1) -> str:
    cap = f" AND b.lvl < {most}" if most else ""
    return f"""b(v, lvl) USING KEY (v) AS (
        SELECT {source}::BIGINT, 0::BIGINT
        UNION SELECT e.dst, min(b.lvl) + 1 FROM b JOIN {edges} e ON e.src = b.v LEFT JOIN recurring.b r ON r.v = e.dst WHERE r.v IS NULL{cap} GROUP BY e.dst)"""


def _sssp_sql(edges: str = "g", source: int = 1) -> str:
    return f"""s(v, dist) USING KEY (v) AS (
        SELECT {source}::BIGINT, 0::BIGINT
        UNION SELECT e.dst, CAST(min(s.dist + e.w) AS BIGINT) FROM s JOIN {edges} e ON e.src = s.v LEFT JOIN recurring.s r ON r.v = e.dst
        WHERE r.v IS NULL OR r.dist > s.dist + e.w GROUP BY e.dst)"""


LEVELS = "SELECT p_partkey AS id, coalesce(lvl, -1) AS level FROM part LEFT JOIN b ON b.v = p_partkey"
DISTANCES = "SELECT p_partkey AS id, coalesce(dist, 2147483647) AS dist FROM part LEFT JOIN s ON s.v = p_partkey"


@query(f"WITH RECURSIVE {CO}, {_bfs_sql()} {LEVELS}")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return bfs(copurchase(spark, d), [1])


@query(f"WITH RECURSIVE {CO_BOTH}, {_bfs_sql('h')} {LEVELS}")
def bfs_undirected(spark: SparkSession, d: str) -> DataFrame:
    return bfs(copurchase(spark, d), [1], directed=False)


@query(f"WITH RECURSIVE {CO}, {_bfs_sql(most=2)} {LEVELS}")
def bfs_capped(spark: SparkSession, d: str) -> DataFrame:
    return bfs(copurchase(spark, d), [1], iter_num=2)


@query(f"WITH RECURSIVE {TREE}, {_bfs_sql(source=0)} SELECT id, coalesce(lvl, -1) AS level FROM v LEFT JOIN b ON b.v = v.id")
def bfs_tree(spark: SparkSession, d: str) -> DataFrame:
    return bfs(tree(spark, d), [0])


@query(f"WITH RECURSIVE {BIP}, h AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), {_bfs_sql('h', source=-1)} SELECT id, coalesce(lvl, -1) AS level FROM v LEFT JOIN b ON b.v = v.id")
def bfs_bipartite(spark: SparkSession, d: str) -> DataFrame:
    return bfs(bipartite(spark, d), [-1], directed=False)


@query(f"""WITH RECURSIVE {CO}, {_bfs_sql()}, l AS ({LEVELS}),
    p AS (SELECT g.dst, max(g.src) AS pred FROM g JOIN l x ON x.id = g.src JOIN l y ON y.id = g.dst WHERE x.level >= 0 AND y.level - x.level = 1 GROUP BY g.dst)
    SELECT id, coalesce(pred, -1) AS pred FROM l LEFT JOIN p ON p.dst = l.id""")
def bfs_predecessors(spark: SparkSession, d: str) -> DataFrame:
    g = copurchase(spark, d)
    return predecessors(g, bfs(g, [1]))


@query(f"WITH RECURSIVE {CO}, {_bfs_sql(most=2)} SELECT count(*) AS traversed FROM g JOIN b ON b.v = g.src")
def bfs_traversed_edges(spark: SparkSession, d: str) -> DataFrame:
    g = copurchase(spark, d)
    return stats.traversed_edges(g, bfs(g, [1], iter_num=2))


@query(f"WITH RECURSIVE {CO}, {_bfs_sql()} SELECT count(*) AS traversed FROM g JOIN b ON b.v = g.src")
def bfs_traversed_edges_whole(spark: SparkSession, d: str) -> DataFrame:
    g = copurchase(spark, d)
    return stats.traversed_edges(g, bfs(g, [1]))


@query(" UNION ALL ".join(f"SELECT id, level, {k}::BIGINT AS source FROM (WITH RECURSIVE {CO}, {_bfs_sql(source=k)} {LEVELS})" for k in (1, 2)))
def bfs_per_source(spark: SparkSession, d: str) -> DataFrame:
    return per_source(bfs, copurchase(spark, d), [1, 2])


@query(f"WITH RECURSIVE {CO}, {_sssp_sql()} {DISTANCES}")
def sssp_push(spark: SparkSession, d: str) -> DataFrame:
    return sssp(copurchase(spark, d), [1])


@query(f"WITH RECURSIVE {CO}, {_sssp_sql()} {DISTANCES}")
def sssp_gather(spark: SparkSession, d: str) -> DataFrame:
    return sssp_pull(copurchase(spark, d), [1])


@query(f"WITH RECURSIVE {CO_BOTH}, {_sssp_sql('h')} {DISTANCES}")
def sssp_undirected(spark: SparkSession, d: str) -> DataFrame:
    return sssp(copurchase(spark, d), [1], directed=False)


@query(f"WITH RECURSIVE {CO}, {_bfs_sql()} {LEVELS}")
def bfs_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Small frontiers by the sparse plan, whatever the graph's size."""
    return bfs(copurchase(spark, d), [1], pass_rows=0)


@query(f"WITH RECURSIVE {CO}, {_sssp_sql()} {DISTANCES}")
def sssp_deltas(spark: SparkSession, d: str) -> DataFrame:
    return sssp(copurchase(spark, d), [1], pass_rows=0)


@query(f"WITH RECURSIVE {HUB}, {_sssp_sql(source=0)} SELECT id, coalesce(dist, 2147483647) AS dist FROM v LEFT JOIN s ON s.v = v.id")
def sssp_hub(spark: SparkSession, d: str) -> DataFrame:
    """A third of all edges leave one vertex, the source."""
    return sssp(hub(spark, d), [0])


@query(f"WITH RECURSIVE {HUB}, h AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), {_bfs_sql('h', source=-2)} SELECT id, coalesce(lvl, -1) AS level FROM v LEFT JOIN b ON b.v = v.id")
def bfs_hub(spark: SparkSession, d: str) -> DataFrame:
    """The vertex of a third of all edges is reached on the way."""
    return bfs(hub(spark, d), [-2], directed=False)


@query(f"""WITH {CO}, one AS (SELECT dst AS v, min(w) AS dist FROM g WHERE src = 1 GROUP BY dst),
    two AS (SELECT g.dst AS v, min(one.dist + g.w) AS dist FROM one JOIN g ON g.src = one.v GROUP BY g.dst),
    s AS (SELECT v, min(dist) AS dist FROM (SELECT 1 AS v, 0 AS dist UNION ALL FROM one UNION ALL FROM two) GROUP BY v)
    SELECT p_partkey AS id, CAST(coalesce(dist, 2147483647) AS BIGINT) AS dist FROM part LEFT JOIN s ON s.v = p_partkey""")
def sssp_capped(spark: SparkSession, d: str) -> DataFrame:
    return sssp(copurchase(spark, d), [1], iter_num=3)


def _labels_sql(edges: str, ids: str) -> str:
    return f"""k(v, low) USING KEY (v) AS (
        SELECT x, x FROM ({ids}) AS t(x)
        UNION SELECT e.dst, min(k.low) FROM k JOIN {edges} e ON e.src = k.v JOIN recurring.k r ON r.v = e.dst WHERE r.low > k.low GROUP BY e.dst)"""


_CHAINS = "SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS component FROM events"


@query(_CHAINS)
def cc_labels(spark: SparkSession, d: str) -> DataFrame:
    return components(event_chains(spark, d))


@query("SELECT count(DISTINCT user_id) AS components FROM events")
def cc_count(spark: SparkSession, d: str) -> DataFrame:
    return stats.component_count(components(event_chains(spark, d)))


@query(f"WITH RECURSIVE {HUB}, h AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), {_labels_sql('h', 'SELECT id FROM v')} SELECT v AS id, low AS component FROM k")
def cc_hub(spark: SparkSession, d: str) -> DataFrame:
    """A third of all edges meet in one vertex, and hot keys are spread at any size."""
    return components(hub(spark, d), task_rows=0)


@query(f"WITH RECURSIVE {CO_BOTH}, {_labels_sql('h', 'SELECT p_partkey FROM part')} SELECT v AS id, low AS component FROM k")
def cc_propagate(spark: SparkSession, d: str) -> DataFrame:
    return components(copurchase(spark, d), mode="propagate")


@query(f"""WITH {EV}, h AS (SELECT * FROM g UNION ALL SELECT dst, src FROM g UNION ALL SELECT event_id, event_id FROM events)
    SELECT x.src AS id, min(y.dst) AS component FROM h x JOIN h y ON y.src = x.dst GROUP BY x.src""")
def cc_capped(spark: SparkSession, d: str) -> DataFrame:
    return components(event_chains(spark, d), iter_num=3)


def _pagerank_sql(edges: str, most: int | None = None) -> str:
    cap = f" AND p.it < {most}" if most is not None else ""
    return f"""deg AS (SELECT src, count(*) AS d FROM {edges} GROUP BY src),
    pr(it, v, rank, active) AS (
        SELECT 0, p_partkey, 0.15::DOUBLE, true FROM part
        UNION ALL (
        WITH got AS (SELECT e.dst AS v, sum(p.rank / deg.d) AS x FROM pr p JOIN {edges} e ON e.src = p.v JOIN deg ON deg.src = e.src GROUP BY e.dst),
        ap AS (
            SELECT p.it + 1 AS it, p.v, CASE WHEN p.active THEN 0.15 + 0.85 * coalesce(got.x, 0) ELSE p.rank END AS rank,
                p.active AND abs(0.15 + 0.85 * coalesce(got.x, 0) - p.rank) >= 0.01 AS changed
            FROM pr p LEFT JOIN got ON got.v = p.v WHERE true{cap}),
        nx AS (SELECT DISTINCT e.dst AS v FROM ap JOIN {edges} e ON e.src = ap.v WHERE ap.changed)
        SELECT ap.it, ap.v, ap.rank, nx.v IS NOT NULL FROM ap LEFT JOIN nx ON nx.v = ap.v WHERE EXISTS (SELECT 1 FROM pr WHERE active)))
    SELECT v AS id, round(rank, 6) AS rank FROM pr WHERE it = (SELECT max(it) FROM pr)"""


def _fixed_sql(rounds: int) -> str:
    return f"""deg AS (SELECT src, count(*) AS d FROM g GROUP BY src),
    pr(it, v, rank) AS (
        SELECT 0, p_partkey, 0.15::DOUBLE FROM part
        UNION ALL (
        WITH got AS (SELECT g.dst AS v, sum(p.rank / deg.d) AS x FROM pr p JOIN g ON g.src = p.v JOIN deg ON deg.src = g.src GROUP BY g.dst)
        SELECT p.it + 1, p.v, 0.15 + 0.85 * coalesce(got.x, 0) FROM pr p LEFT JOIN got ON got.v = p.v WHERE p.it < {rounds}))
    SELECT v AS id, round(rank, 6) AS rank FROM pr WHERE it = {rounds}"""


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH RECURSIVE {CO}, {_pagerank_sql('g')}")
def pagerank_frontier(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pagerank(copurchase(spark, d)))


@query(f"WITH RECURSIVE {CO}, {_pagerank_sql('g')}")
def pagerank_gathered(spark: SparkSession, d: str) -> DataFrame:
    """Small frontiers gather over their own edges only, whatever the graph's size."""
    return _rounded(pagerank(copurchase(spark, d), pass_rows=0))


@query(f"WITH RECURSIVE {CO}, {_pagerank_sql('g', 3)}")
def pagerank_capped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pagerank(copurchase(spark, d), iter_num=3))


@query(f"WITH RECURSIVE {CO_BOTH}, {_pagerank_sql('h')}")
def pagerank_undirected(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pagerank(copurchase(spark, d), directed=False))


@query(f"WITH RECURSIVE {CO}, {_fixed_sql(10)}")
def pagerank_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pagerank_fixed(copurchase(spark, d), 10))


@query(f"""WITH RECURSIVE {CO}, deg AS (SELECT src, count(*) AS d FROM g GROUP BY src),
    pr(it, v, rank, due) AS (
        SELECT 0, p_partkey, 0.15::DOUBLE, 0.15::DOUBLE FROM part
        UNION ALL (
        WITH got AS (SELECT g.dst AS v, 0.85 * sum(p.due / deg.d) AS x FROM pr p JOIN g ON g.src = p.v JOIN deg ON deg.src = g.src WHERE abs(p.due) >= 0.01 GROUP BY g.dst)
        SELECT p.it + 1, p.v, p.rank + coalesce(got.x, 0), CASE WHEN abs(p.due) >= 0.01 THEN 0 ELSE p.due END + coalesce(got.x, 0)
        FROM pr p LEFT JOIN got ON got.v = p.v WHERE EXISTS (SELECT 1 FROM pr WHERE abs(due) >= 0.01)))
    SELECT v AS id, round(rank, 6) AS rank FROM pr WHERE it = (SELECT max(it) FROM pr)""")
def pagerank_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pagerank_delta(copurchase(spark, d)))


def _gathered(spark: SparkSession, d: str, along: Along, active: str = "size <= 5") -> DataFrame:
    """Sum of (size of the neighbour + weight) over the edges of the active parts; unless given, those of size 1 to 5, every tenth kind."""
    from weftgraph.session import table

    g = copurchase(spark, d)
    state = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return gather(state.filter(active), state, g.edges, along, lambda s, e: s("size") + e("w"), "sum", 0)


def _gather_sql(edges: str, active: str = "f.p_size <= 5") -> str:
    return f"""WITH {CO}, e AS ({edges})
    SELECT f.p_partkey AS id, CAST(coalesce(sum(n.p_size + e.w), 0) AS BIGINT) AS gathered
    FROM part f LEFT JOIN e ON e.v = f.p_partkey LEFT JOIN part n ON n.p_partkey = e.u WHERE {active} GROUP BY f.p_partkey"""


_OUT, _IN = "SELECT src AS v, dst AS u, w FROM g", "SELECT dst AS v, src AS u, w FROM g"


@query(_gather_sql(_IN))
def gas_gather_in(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, Along.IN)


@query(_gather_sql(_OUT))
def gas_gather_out(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, Along.OUT)


@query(_gather_sql(f"{_OUT} UNION ALL {_IN}"))
def gas_gather_all(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, Along.ALL)


@query(_gather_sql(_IN, "true"))
def gas_gather_in_whole(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, Along.IN, "true")


@query(_gather_sql(_OUT, "true"))
def gas_gather_out_whole(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, Along.OUT, "true")


@query(_gather_sql(f"{_OUT} UNION ALL {_IN}", "true"))
def gas_gather_all_whole(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, Along.ALL, "true")


def _expanded(spark: SparkSession, d: str, along: Along, active: str = "p_size <= 5") -> DataFrame:
    from weftgraph.session import table

    g = copurchase(spark, d)
    sending = table(spark, d, "part").filter(active).select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return expand(sending, g.edges, along, lambda s, e: s("size") + e("w"), "min")


def _expand_sql(edges: str, active: str = "p_size <= 5") -> str:
    return f"WITH {CO}, e AS ({edges}) SELECT e.u AS id, min(p_size + e.w) AS msg FROM part JOIN e ON e.v = p_partkey WHERE {active} GROUP BY e.u"


@query(_expand_sql(_OUT))
def expand_out(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, Along.OUT)


@query(_expand_sql(_IN))
def expand_in(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, Along.IN)


@query(_expand_sql(f"{_OUT} UNION ALL {_IN}"))
def expand_all(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, Along.ALL)


@query(_expand_sql(_IN, "true"))
def expand_in_whole(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, Along.IN, "true")


@query(_expand_sql(_OUT, "true"))
def expand_out_whole(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, Along.OUT, "true")


@query(_expand_sql(f"{_OUT} UNION ALL {_IN}", "true"))
def expand_all_whole(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, Along.ALL, "true")


_DEG = "SELECT p_partkey AS id, count(src) AS degree FROM part LEFT JOIN {0} ON src = p_partkey GROUP BY p_partkey"


@query(f"WITH {CO} {_DEG.format('g')}")
def degree_out(spark: SparkSession, d: str) -> DataFrame:
    return stats.degrees(copurchase(spark, d))


@query(f"WITH {CO_BOTH} {_DEG.format('h')}")
def degree_undirected(spark: SparkSession, d: str) -> DataFrame:
    return stats.degrees(copurchase(spark, d), directed=False)


@query(f"""WITH {CO}, x AS ({_DEG.format('g')})
    SELECT CASE WHEN degree = 0 THEN -1 ELSE CAST(floor(log2(degree)) AS INTEGER) END AS bucket, count(*) AS n,
        round(count(*) * 100.0 / (SELECT count(*) FROM part), 6)::DOUBLE AS percent FROM x GROUP BY 1""")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.degree_histogram(copurchase(spark, d)).select("bucket", "n", F.round(F.col("percent").cast("double"), 6).alias("percent"))


@query(f"WITH {CO}, x AS ({_DEG.format('g')}) SELECT id, degree FROM x ORDER BY degree DESC, id LIMIT 1")
def max_degree_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.max_degree(copurchase(spark, d))


@query(f"WITH {CO} SELECT dst AS src, src AS dst, w FROM g")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return copurchase(spark, d).transpose().edges


@query(f"WITH {CO}, x AS ({_DEG.format('g')}) SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM x")
def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return stats.offsets(copurchase(spark, d))


@query(f"WITH {CO} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src AS id FROM g")
def csr_indices(spark: SparkSession, d: str) -> DataFrame:
    g = copurchase(spark, d)
    return stats.indices(stats.offsets(g).join(stats.degrees(g), "id"))


@query(f"WITH {CO} SELECT src, dst, w, row_number() OVER (ORDER BY src, dst, w) - 1 AS eid FROM g")
def edge_ids(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_ids(copurchase(spark, d))


@query(f"""WITH {CO} SELECT p_partkey AS id,
    coalesce((SELECT string_agg(dst, ' ' ORDER BY dst) FROM g WHERE src = p_partkey), '') AS out,
    coalesce((SELECT string_agg(src, ' ' ORDER BY src) FROM g WHERE dst = p_partkey), '') AS "into" FROM part""")
def adjacency_dump(spark: SparkSession, d: str) -> DataFrame:
    a = stats.adjacency(copurchase(spark, d))
    return a.select("id", F.concat_ws(" ", F.transform("out", lambda x: x.cast("string"))).alias("out"), F.concat_ws(" ", F.transform("into", lambda x: x.cast("string"))).alias("into"))
