"""Queries of the operators on ordered arrays, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import elementwise
from weftgraph.operators import order, relational, scan
from weftgraph.plans.graphs import A, B, MATRIX, O, array_a, array_b, array_o, part_supplier
from weftgraph.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, f) -> None:  # noqa: ANN001
    def q(spark: SparkSession, d: str) -> DataFrame:
        return f(spark, d)

    q.__name__ = name
    QUERIES[name] = q
    if sql:
        ORACLE_SQL[name] = sql


def _counted(s: SparkSession, d: str) -> DataFrame:
    pos = table(s, d, "part").select(F.col("p_partkey").alias("pos"))
    return pos.join(elementwise.counting(s, (pos.agg(F.max("pos")).first()[0] or 0) + 1, 5, 3), "pos")


# Filters and compaction.
_add("copy_if", f"WITH {O} SELECT pos, key, val, row_number() OVER (ORDER BY pos) - 1 AS new_pos FROM o WHERE val < 50",
     lambda s, d: order.copy_if(array_o(s, d), "val < 50", "pos"))
_add("consecutive_removal", f"WITH {B} SELECT pos, key, val FROM (SELECT *, lag(key) OVER (ORDER BY pos) AS p FROM b) WHERE p IS DISTINCT FROM key",
     lambda s, d: order.consecutive_removal(array_b(s, d), "pos", "key"))
_add("bulk_remove", f"WITH {O} SELECT pos, key, val, row_number() OVER (ORDER BY pos) - 1 AS new_pos FROM o WHERE pos NOT IN (SELECT p_partkey * 3 FROM part)",
     lambda s, d: order.bulk_remove(array_o(s, d), "pos", table(s, d, "part").select((F.col("p_partkey") * 3).alias("pos"))))
_add("bulk_insert", f"""WITH {A}, {B}, x AS (SELECT pos * 13 % 1009 AS place, 0 AS t, pos, val FROM a UNION ALL SELECT pos, 1, pos, val FROM b)
    SELECT row_number() OVER (ORDER BY place, t, pos) - 1 AS new_pos, CASE t WHEN 0 THEN 'a' ELSE 'b' END AS side, pos, val FROM x""",
     lambda s, d: order.bulk_insert(array_a(s, d).withColumn("at", F.col("pos") * 13 % 1009), array_b(s, d)))
_add("adjacent_difference", f"WITH {O} SELECT pos, key, val, val - coalesce(lag(val) OVER (ORDER BY pos), 0) AS diff FROM o",
     lambda s, d: order.adjacent_difference(array_o(s, d), "pos", "val"))
_add("transform_plus", f"WITH {A}, {B} SELECT pos, a.val + b.val AS val FROM a JOIN b USING (pos)",
     lambda s, d: elementwise.zip_transform(array_a(s, d), array_b(s, d), "plus"))
_add("gather_values", f"WITH {A}, {B} SELECT a.pos, b.val FROM a JOIN b ON b.pos = a.pos * 17 % 1201",
     lambda s, d: order.gather_values(array_a(s, d).withColumn("at", F.col("pos") * 17 % 1201), array_b(s, d)))
_add("scatter_values", f"WITH {O} SELECT pos * 7 % 4099 AS pos, arg_max(val, pos) AS val FROM o GROUP BY 1",
     lambda s, d: order.scatter_values(array_o(s, d).withColumn("at", F.col("pos") * 7 % 4099)))
_add("scatter_if", f"WITH {O} SELECT pos * 7 % 4099 AS pos, arg_max(val, pos) AS val FROM o WHERE val % 2 = 0 GROUP BY 1",
     lambda s, d: order.scatter_values(array_o(s, d).withColumn("at", F.col("pos") * 7 % 4099), condition=F.col("val") % 2 == 0))
_add("counting_step", "SELECT p_partkey AS pos, p_partkey * 3 + 5 AS val FROM part",
     _counted)

_add("memset", "SELECT range AS pos, 7 AS val FROM range((SELECT count(*) FROM part))", lambda s, d: elementwise.constant(s, table(s, d, "part").count(), 7))
_add("copy_array", f"WITH {A} FROM a", lambda s, d: elementwise.copy(array_a(s, d)))

_BINARY = {"plus": "val + key", "minus": "val - key", "multiplies": "val * key", "modulus": "val % (key + 1)", "bit_or": "val | key", "bit_and": "val & key", "bit_xor": "xor(val, key)", "maximum": "greatest(val, key)", "minimum": "least(val, key)"}
_COMPARED = {"less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "equal_to": "=", "not_equal_to": "<>"}


def _elementwise(s: SparkSession, d: str) -> DataFrame:
    a, ops = array_a(s, d).withColumn("key1", F.col("key") + 1), {**elementwise.ARITHMETIC, **elementwise.COMPARE}
    return a.select("pos", *(ops[o](F.col("val"), F.col("key1" if o == "modulus" else "key")).alias(o) for o in [*_BINARY, *_COMPARED]))


_add("elementwise_ops", f"WITH {A} SELECT pos, " + ", ".join([f"{v} AS {k}" for k, v in _BINARY.items()] + [f"val {v} key AS {k}" for k, v in _COMPARED.items()]) + " FROM a", _elementwise)

# Reductions.
_add("reduce_ops", f'WITH {O} SELECT CAST(sum(val) AS BIGINT) AS sum, min(val) AS min, max(val) AS max, bit_and(val) AS bit_and, bit_or(val) AS bit_or, bit_xor(val) AS bit_xor FROM o',
     lambda s, d: relational.reduce_all(array_o(s, d), "val", ["sum", "min", "max", "bit_and", "bit_or", "bit_xor"]))
_add("reduce_product", "SELECT product(n_nationkey % 3 + 1) AS value FROM nation",
     lambda s, d: relational.reduce_with(table(s, d, "nation").select((F.col("n_nationkey") % 3 + 1).alias("val")), "val", F.product, 1.0))
_add("reduce_by_key_runs", f"""WITH {B}, f AS (SELECT *, CASE WHEN lag(key) OVER (ORDER BY pos) IS DISTINCT FROM key THEN 1 ELSE 0 END AS n FROM b),
    r AS (SELECT *, sum(n) OVER (ORDER BY pos) - 1 AS run FROM f) SELECT CAST(run AS BIGINT) AS run, key, CAST(sum(val) AS BIGINT) AS value FROM r GROUP BY run, key""",
     lambda s, d: order.reduce_by_run(array_b(s, d), "pos", "key", F.sum("val")))
_SEGMENTS = "SELECT c_custkey AS key FROM customer"
_add("seg_reduce_empty", f"WITH {O} SELECT c_custkey AS key, CAST(coalesce(sum(val), 0) AS BIGINT) AS value FROM customer LEFT JOIN o ON o.key = c_custkey GROUP BY c_custkey",
     lambda s, d: relational.segmented_reduce(array_o(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("key")), "key", F.sum("val"), 0))
_add("indirect_reduce", f"WITH {O} SELECT c_custkey AS key, coalesce(max(val), -1) AS value FROM customer LEFT JOIN o ON o.key = c_custkey * 3 % 1000 GROUP BY c_custkey",
     lambda s, d: relational.indirect_reduce(array_o(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 3 % 1000).alias("source")), "key", "source", F.max("val"), -1))
_add("sorted_equality_count", f"WITH {A}, {B} SELECT a.pos, a.key, a.val, count(b.key) AS n FROM a LEFT JOIN b ON b.key = a.key GROUP BY ALL",
     lambda s, d: relational_count(array_a(s, d), array_b(s, d)))


def relational_count(a: DataFrame, b: DataFrame) -> DataFrame:
    return order.equality_count(a, b)


# Sparse products.
_X = "x AS (SELECT s_suppkey AS col, CAST(s_suppkey % 7 AS DOUBLE) AS x FROM supplier)"


def _x(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("col"), (F.col("s_suppkey") % 7).cast("double").alias("x"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("row"))


def _spmv_sql(term: str, plus: str, other: str) -> str:
    return f"WITH {MATRIX}, {_X} SELECT p_partkey AS row, {other.format(f'{plus}({term})')} AS y FROM part LEFT JOIN (m JOIN x USING (col)) ON row = p_partkey GROUP BY p_partkey"


_add("spmv_binary", _spmv_sql("value * x", "sum", "coalesce({0}, 0.0)"), lambda s, d: relational.spmv(part_supplier(s, d), _x(s, d), _parts(s, d)))
_add("spmv_unary", _spmv_sql("x", "sum", "coalesce({0}, 0.0)"), lambda s, d: relational.spmv(part_supplier(s, d), _x(s, d), _parts(s, d), unary=True))
_add("spmv_minplus", _spmv_sql("value + x", "min", "{0}"), lambda s, d: relational.spmv(part_supplier(s, d), _x(s, d), _parts(s, d), relational.MIN_PLUS))
_add("spmv_indirect", f"""WITH {MATRIX}, {_X}, y AS (SELECT row, sum(value * x) AS y FROM m JOIN x USING (col) GROUP BY row)
    SELECT p_partkey AS row, coalesce(y.y, 0.0) AS y FROM part LEFT JOIN y ON y.row = p_partkey * 11 % 1500""",
     lambda s, d: relational.spmv_indirect(part_supplier(s, d), _x(s, d), _parts(s, d).withColumn("source", F.col("row") * 11 % 1500)))


def _two_products(s: SparkSession, d: str) -> DataFrame:
    """One layout of the matrix, two vectors."""
    m = relational.PreparedMatrix(part_supplier(s, d))
    x = _x(s, d)
    one, two = m.apply(x).withColumnRenamed("y", "y1"), m.apply(x.select("col", (F.col("x") + 1).alias("x"))).withColumnRenamed("y", "y2")
    return one.join(two, "row")


_add("spmv_prepared", f"WITH {MATRIX}, {_X} SELECT row, sum(value * x) AS y1, sum(value * (x + 1)) AS y2 FROM m JOIN x USING (col) GROUP BY row", _two_products)


def _two_reductions(s: SparkSession, d: str) -> DataFrame:
    o = array_o(s, d)
    p = relational.PreparedSegments(o.select("pos", F.col("key").alias("seg")))
    return p.apply(o.select("pos", "val"), F.sum("val"), "a").join(p.apply(o.select("pos", (F.col("val") * 2 + 1).alias("val")), F.max("val"), "b"), "seg")


_add("seg_reduce_prepared", f"WITH {O} SELECT key AS seg, CAST(sum(val) AS BIGINT) AS a, max(val * 2 + 1) AS b FROM o GROUP BY key", _two_reductions)


def _runs_prepared(s: SparkSession, d: str) -> DataFrame:
    b = array_b(s, d)
    p = relational.PreparedSegments(order.runs(b, "pos", "key", "run"), seg="run")
    return p.apply(b, F.sum("val"), "total").join(p.apply(b, F.count("*"), "n"), "run")


_add("reduce_by_key_prepared", f"""WITH {B}, f AS (SELECT *, CASE WHEN lag(key) OVER (ORDER BY pos) IS DISTINCT FROM key THEN 1 ELSE 0 END AS n FROM b),
    r AS (SELECT *, sum(n) OVER (ORDER BY pos) - 1 AS run FROM f) SELECT CAST(run AS BIGINT) AS run, CAST(sum(val) AS BIGINT) AS total, count(*) AS n FROM r GROUP BY run""", _runs_prepared)


def _bt(s: SparkSession, d: str) -> DataFrame:
    """The matrix transposed, with parts folded to 50 columns."""
    return part_supplier(s, d).select(F.col("col").alias("row"), (F.col("row") % 50).alias("col"), "value")


def _at(s: SparkSession, d: str) -> DataFrame:
    return part_supplier(s, d).select((F.col("row") % 200).alias("row"), "col", "value")


_AB = f"{MATRIX}, p AS (SELECT row % 200 AS row, col AS mid, value FROM m), q AS (SELECT col AS mid, row % 50 AS col, value FROM m)"
_add("spgemm", f"WITH {_AB} SELECT p.row, q.col, sum(p.value * q.value) AS value, count(*) AS n FROM p JOIN q USING (mid) GROUP BY p.row, q.col",
     lambda s, d: relational.spgemm(_at(s, d), _bt(s, d)))
# The whole product has about as many cells as pairs of parts; no SQL, which would be too slow.
_add("spgemm_whole", None, lambda s, d: relational.spgemm(part_supplier(s, d), part_supplier(s, d).select(F.col("col").alias("row"), F.col("row").alias("col"), "value")))
_add("spgemm_products", f"WITH {_AB}, x AS (SELECT mid, count(*) AS n FROM p GROUP BY mid), y AS (SELECT mid, count(*) AS n FROM q GROUP BY mid) SELECT CAST(sum(x.n * y.n) AS BIGINT) AS products FROM x JOIN y USING (mid)",
     lambda s, d: relational.products(_at(s, d), _bt(s, d)))
_add("column_ranges", f"WITH {MATRIX} SELECT row, min(col) AS first_col, max(col) AS last_col FROM m GROUP BY row", lambda s, d: relational.column_ranges(part_supplier(s, d)))
_add("strip_empty_rows", "SELECT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
     lambda s, d: relational.strip_empty_rows(array_o(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("key")), "key"))

# Scans.
_add("scan_inclusive", f"WITH {O} SELECT pos, key, val, CAST(sum(val) OVER (ORDER BY pos) AS BIGINT) AS scan FROM o", lambda s, d: scan.scan(array_o(s, d), "pos", "val"))
_add("scan_exclusive", f"WITH {O} SELECT pos, key, val, CAST(coalesce(sum(val) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM o",
     lambda s, d: scan.scan(array_o(s, d), "pos", "val", inclusive=False))
_add("seg_scan", f"WITH {O} SELECT pos, key, val, CAST(sum(val) OVER (PARTITION BY key ORDER BY pos) AS BIGINT) AS scan FROM o", lambda s, d: scan.scan(array_o(s, d), "pos", "val", seg="key"))
_add("seg_scan_flags", f"""WITH {O}, f AS (SELECT *, CAST(sum(CASE WHEN val < 9 THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS seg FROM o)
    SELECT pos, key, val, seg, CAST(sum(val) OVER (PARTITION BY seg ORDER BY pos) AS BIGINT) AS scan FROM f""",
     lambda s, d: scan.scan(scan.segments_from_flags(array_o(s, d).withColumn("f", F.col("val") < 9), "pos", "f").select("pos", "key", "val", "seg"), "pos", "val", seg="seg"))
_add("max_scan", f"WITH {O} SELECT pos, key, val, max(key) OVER (ORDER BY pos) AS scan FROM o", lambda s, d: scan.max_scan(array_o(s, d), "pos", "key"))

_add("scan_total", f"WITH {O} SELECT CAST(sum(val) AS BIGINT) AS total FROM o", lambda s, d: scan.scan_with_total(array_o(s, d), "pos", "val")[1])
# A reduction of one's own: the largest of absolute values.
_LARGEST = (lambda c: F.max(F.abs(F.col(c) if isinstance(c, str) else c)), F.greatest)
_add("scan_own_operator", f"WITH {O} SELECT pos, key, val - 50 AS val, CAST(max(abs(val - 50)) OVER (ORDER BY pos) AS BIGINT) AS scan FROM o",
     lambda s, d: scan.scan(array_o(s, d).select("pos", "key", (F.col("val") - 50).alias("val")), "pos", "val", _LARGEST))

# Sorting, merging, searching.
_add("sort_descending", f"WITH {O} SELECT row_number() OVER (ORDER BY key DESC, pos) - 1 AS rank, key, pos FROM o", lambda s, d: order.sort_keys(array_o(s, d), "key", "pos", order=lambda c: c.desc()).select("rank", "key", "pos"))
# Nearly sorted: each order's number, with neighbours swapped.
_add("locality_sort", f"WITH {O} SELECT row_number() OVER (ORDER BY xor(pos, 1), pos) - 1 AS rank, xor(pos, 1) AS key, pos FROM o",
     lambda s, d: order.sort_keys(array_o(s, d).select("pos", F.col("pos").bitwiseXOR(F.lit(1)).alias("key")), "key", "pos"))
_add("seg_sort_flags", f"""WITH {O}, f AS (SELECT *, CAST(sum(CASE WHEN val < 9 THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS seg FROM o)
    SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY key, pos) - 1 AS rank, key, pos FROM f""",
     lambda s, d: order.segmented_sort(scan.segments_from_flags(array_o(s, d).withColumn("f", F.col("val") < 9), "pos", "f"), "seg", "key", "pos").select("seg", "rank", "key", "pos"))
_add("sort_keys", f"WITH {O} SELECT row_number() OVER (ORDER BY key, pos) - 1 AS rank, key FROM o", lambda s, d: order.sort_keys(array_o(s, d), "key", "pos").select("rank", "key"))
_add("sort_pairs", f"WITH {O} SELECT row_number() OVER (ORDER BY key, pos) - 1 AS rank, key, val FROM o", lambda s, d: order.sort_keys(array_o(s, d), "key", "pos").select("rank", "key", "val"))
_add("sort_indices", f"WITH {O} SELECT row_number() OVER (ORDER BY key, pos) - 1 AS rank, pos FROM o", lambda s, d: order.sort_keys(array_o(s, d), "key", "pos").select("rank", "pos"))
_add("radix_sort", f"WITH {O} SELECT row_number() OVER (ORDER BY (key >> 2) & 63, pos) - 1 AS rank, key, pos FROM o", lambda s, d: order.radix_sort(array_o(s, d), "key", "pos", 2, 8).select("rank", "key", "pos"))
_add("seg_sort", f"WITH {O} SELECT key, row_number() OVER (PARTITION BY key ORDER BY val, pos) - 1 AS rank, val, pos FROM o", lambda s, d: order.segmented_sort(array_o(s, d), "key", "val", "pos").select("key", "rank", "val", "pos"))
_add("seg_sort_starts", f"""WITH {A}, t AS (SELECT DISTINCT s_suppkey * 19 AS start FROM supplier),
    g AS (SELECT a.*, (SELECT count(*) FROM t WHERE start > 0 AND start <= a.pos) AS seg FROM a)
    SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY key, pos) - 1 AS rank, key, pos FROM g""",
     lambda s, d: order.segmented_sort(order.segments_from_starts(array_a(s, d), "pos", table(s, d, "supplier").select((F.col("s_suppkey") * 19).alias("start"))), "seg", "key", "pos").select("seg", "rank", "key", "pos"))
_MERGED = f"WITH {A}, {B}, u AS (SELECT 0 AS t, * FROM a UNION ALL SELECT 1, * FROM b)"
_add("merge_keys", f"{_MERGED} SELECT row_number() OVER (ORDER BY key, t, pos) - 1 AS new_pos, key FROM u", lambda s, d: order.merge(array_a(s, d), array_b(s, d)).select("new_pos", "key"))
_add("merge_pairs", f"{_MERGED} SELECT row_number() OVER (ORDER BY key, t, pos) - 1 AS new_pos, key, val, CASE t WHEN 0 THEN 'a' ELSE 'b' END AS side FROM u", lambda s, d: order.merge(array_a(s, d), array_b(s, d)).select("new_pos", "key", "val", "side"))
_SEARCH = "WITH {a}, {b}, k AS (SELECT key, count(*) AS n FROM b GROUP BY key) SELECT a.pos, a.key, CAST(coalesce((SELECT sum(n) FROM k WHERE k.key {op} a.key), 0) AS BIGINT) AS index FROM a"
_add("sorted_search_lower", _SEARCH.format(a=A, b=B, op="<"), lambda s, d: order.sorted_search(array_a(s, d), array_b(s, d)))
_add("sorted_search_upper", _SEARCH.format(a=A, b=B, op="<="), lambda s, d: order.sorted_search(array_a(s, d), array_b(s, d), upper=True))
_BOTH = """WITH {a}, {b}, k AS (SELECT key, count(*) AS n FROM b GROUP BY key), l AS (SELECT key, count(*) AS n FROM a GROUP BY key)
    SELECT 'a' AS side, a.pos, a.key, CAST(coalesce((SELECT sum(n) FROM k WHERE k.key < a.key), 0) AS BIGINT) AS index, a.key IN (SELECT key FROM k) AS match FROM a
    UNION ALL SELECT 'b', b.pos, b.key, CAST(coalesce((SELECT sum(n) FROM l WHERE l.key <= b.key), 0) AS BIGINT), b.key IN (SELECT key FROM l) FROM b"""
_add("sorted_search_both", _BOTH.format(a=A, b=B), lambda s, d: order.search_both(array_a(s, d), array_b(s, d)))
_add("sorted_search_counts", f"WITH {A}, {B} SELECT (SELECT count(*) FROM a WHERE key IN (SELECT key FROM b)) AS a_matches, (SELECT count(*) FROM b WHERE key IN (SELECT key FROM a)) AS b_matches",
     lambda s, d: order.match_counts(array_a(s, d), array_b(s, d)))
_add("search_match", f"WITH {A}, {B} SELECT pos, key, val, key IN (SELECT key FROM b) AS match FROM a", lambda s, d: order.search_match(array_a(s, d), array_b(s, d)))
_add("load_balance_search", f"""WITH {A}, x AS (SELECT pos AS owner, val % 4 AS n, sum(val % 4) OVER (ORDER BY pos) - val % 4 AS place FROM a)
    SELECT CAST(place + k AS BIGINT) AS item, owner, k AS rank FROM (SELECT owner, place, unnest(range(n)) AS k FROM x)""",
     lambda s, d: order.load_balance(array_a(s, d).withColumn("n", F.col("val") % 4), "pos", "n"))

# Intervals.
_add("interval_expand", f"""WITH {A}, x AS (SELECT key, val % 4 AS n, sum(val % 4) OVER (ORDER BY pos) - val % 4 AS place FROM a)
    SELECT CAST(place + k AS BIGINT) AS item, key AS value FROM (SELECT key, place, unnest(range(n)) AS k FROM x)""",
     lambda s, d: order.interval_expand(array_a(s, d).withColumn("n", F.col("val") % 4), "pos", "n", "key"))
_INTERVALS = f"""WITH {A}, {O}, i AS (
    SELECT pos, pos * 5 % 1400 AS g, pos * 3 AS s, val % 4 AS n, CAST(sum(val % 4) OVER (ORDER BY pos) - val % 4 AS BIGINT) AS place FROM a),
    e AS (SELECT *, unnest(range(n)) AS k FROM i)"""


def _intervals(s: SparkSession, d: str) -> DataFrame:
    return array_a(s, d).select("pos", (F.col("pos") * 5 % 1400).alias("gather"), (F.col("pos") * 3).alias("scatter"), (F.col("val") % 4).alias("count"))


for _name, _g, _s in (("interval_move", True, True), ("interval_gather", True, False), ("interval_scatter", False, True)):
    _add(_name, f"{_INTERVALS} SELECT {'s' if _s else 'place'} + k AS \"to\", o.val FROM e JOIN o ON o.pos = {'g' if _g else 'place'} + k",
         lambda s, d, g=_g, w=_s: order.interval_move(_intervals(s, d), array_o(s, d), gather=g, scatter=w))

# Joins. Keys are narrowed so that pairs stay in proportion to the rows; the whole ones take the arrays' own keys.
_JOIN = f"WITH {A}, {B}, x AS (SELECT pos, key * 100 + val AS key FROM a), y AS (SELECT pos, key * 100 + val AS key FROM b)"


def _join(kind: str):  # noqa: ANN202
    def run(s: SparkSession, d: str) -> DataFrame:
        narrow = lambda t: t.select("pos", (F.col("key") * 100 + F.col("val")).alias("key"))
        return relational.relational_join(narrow(array_a(s, d)), narrow(array_b(s, d)), kind)

    return run


for _k in ("inner", "left", "right", "full"):
    _add(f"join_{_k}", f"{_JOIN} SELECT coalesce(x.key, y.key) AS key, coalesce(x.pos, -1) AS a_pos, coalesce(y.pos, -1) AS b_pos FROM x {_k} JOIN y ON x.key = y.key", _join(_k))
    _add(f"join_{_k}_whole", f"WITH {A}, {B} SELECT coalesce(a.key, b.key) AS key, coalesce(a.pos, -1) AS a_pos, coalesce(b.pos, -1) AS b_pos FROM a {_k} JOIN b ON a.key = b.key",
         lambda s, d, k=_k: relational.relational_join(array_a(s, d), array_b(s, d), k))
_add("semi_join", f"WITH {A}, {B} SELECT pos, key, val FROM a WHERE key IN (SELECT key FROM b)", lambda s, d: relational.semi_join(array_a(s, d), array_b(s, d)))
_add("anti_join", f"WITH {A}, {B} SELECT pos, key, val FROM a WHERE key NOT IN (SELECT key FROM b)", lambda s, d: relational.anti_join(array_a(s, d), array_b(s, d)))

# Multisets.
_KEYS = f"WITH {A}, {B}, x AS (SELECT key FROM a), y AS (SELECT key FROM b)"
_add("set_intersect_all", f"{_KEYS} FROM x INTERSECT ALL FROM y", lambda s, d: relational.intersection(array_a(s, d).select("key"), array_b(s, d).select("key")))
_add("set_diff_all", f"{_KEYS} FROM x EXCEPT ALL FROM y", lambda s, d: relational.difference(array_a(s, d).select("key"), array_b(s, d).select("key")))
_add("set_symdiff_all", f"{_KEYS} (FROM x EXCEPT ALL FROM y) UNION ALL (FROM y EXCEPT ALL FROM x)", lambda s, d: relational.symmetric_difference(array_a(s, d).select("key"), array_b(s, d).select("key")))
_add("set_union_max", f"{_KEYS} FROM x UNION ALL (FROM y EXCEPT ALL FROM x)", lambda s, d: relational.union(array_a(s, d).select("key"), array_b(s, d).select("key")))
_DISTINCT = {"intersection": "INTERSECT", "union": "UNION", "difference": "EXCEPT"}
for _k, _op in _DISTINCT.items():
    _add(f"set_distinct_{_k}", f"WITH {A}, {B}, x AS (SELECT DISTINCT val FROM a), y AS (SELECT DISTINCT val FROM b) FROM x {_op} FROM y",
         lambda s, d, k=_k: relational.set_operation(array_a(s, d).select("val").distinct(), array_b(s, d).select("val").distinct(), k))
_add("set_distinct_symmetric_difference", f"WITH {A}, {B}, x AS (SELECT DISTINCT val FROM a), y AS (SELECT DISTINCT val FROM b) (FROM x EXCEPT FROM y) UNION ALL (FROM y EXCEPT FROM x)",
     lambda s, d: relational.set_operation(array_a(s, d).select("val").distinct(), array_b(s, d).select("val").distinct(), "symmetric_difference"))
_PAIRED = f"""WITH {A}, {B}, x AS (SELECT key, pos AS pa, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS occ FROM a),
    y AS (SELECT key, pos AS pb, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS occ FROM b)
    SELECT key, occ, CASE WHEN pa IS NULL THEN 'b' ELSE 'a' END AS side, coalesce(pa, pb) AS pos FROM x FULL JOIN y USING (key, occ) WHERE """
for _k, _c in (("intersection", "pa IS NOT NULL AND pb IS NOT NULL"), ("union", "true"), ("difference", "pb IS NULL"), ("symmetric_difference", "pa IS NULL OR pb IS NULL")):
    _add(f"set_pairs_{_k}", _PAIRED + _c, lambda s, d, k=_k: relational.paired_sets(array_a(s, d), array_b(s, d), k))
