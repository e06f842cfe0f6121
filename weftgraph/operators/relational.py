"""Joins by position, multiset operations, segmented reductions and sparse products."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.engine import Layout
from weftgraph.operators.hot import SHARE
from weftgraph.operators.order import number_rows, repeated
from weftgraph.program import Along
from weftgraph.session import Workspace, buckets_for

NO_MATCH = -1
#: Pairs of a join in one block, and blocks in one task.
BLOCK_PAIRS = 2_000_000
TASK_BLOCKS = 8
#: Products of matrices that one task forms.
BLOCK_PRODUCTS = 1_000_000


def relational_join(a: DataFrame, b: DataFrame, kind: str = "inner", key: str = "key", pos: str = "pos", block: int = BLOCK_PAIRS) -> DataFrame:
    """(key, a_pos, b_pos): one row for each pair of equal keys; ``kind`` inner, left, right or
    full keeps rows without a partner, whose position is then -1.  Null keys match nothing.

    Pairs are counted first.  Beyond ``block`` of them, tasks get equal shares of the pairs and not of
    the rows: a key with more than ``block`` pairs (and more than 1 / SHARE of all) is cut into blocks
    of its rows on both sides."""
    x = a.select(F.col(key).alias("ka"), F.col(pos).alias("pa"))
    y = b.select(F.col(key).alias("kb"), F.col(pos).alias("pb"))
    same = F.col("ka") == F.col("kb")
    na, nb = F.col("_na").cast("double"), F.col("_nb").cast("double")
    counts = x.groupBy("ka").agg(F.count("*").alias("_na")).join(y.groupBy("kb").agg(F.count("*").alias("_nb")), same).select("ka", "_na", "_nb", (na * nb).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if (total or 0) <= block:
        j = x.join(y, same, kind)
    else:
        n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (TASK_BLOCKS * block)))
        size = max(block, total / SHARE)
        if most <= size:
            j = _matched(x, y, kind, n)
        else:
            # Copies of rows are fewest where blocks have as many rows of either side.
            parts = F.least(na, F.ceil(F.sqrt(F.col("_n") / size * na / nb)))
            hot = counts.filter(F.col("_n") > size).select(F.col("ka").alias("_key"), parts.cast("int").alias("_pa"), F.ceil(F.col("_n") / size / parts).cast("int").alias("_pb"))
            few = F.broadcast(hot)
            cold = _matched(x.join(few, F.col("ka") == F.col("_key"), "left_anti"), y.join(few, F.col("kb") == F.col("_key"), "left_anti"), kind, n)
            u = x.join(few, F.col("ka") == F.col("_key")).select("ka", "pa", _part("pa", "_pa").alias("_ia"), _copies("_pb").alias("_ja"))
            v = y.join(few, F.col("kb") == F.col("_key")).select("kb", "pb", _copies("_pa").alias("_ib"), _part("pb", "_pb").alias("_jb"))
            u, v = u.repartition(n, "ka", "_ia", "_ja"), v.repartition(n, "kb", "_ib", "_jb")
            # All rows of a hot key have partners, so these are inner joins for any kind.
            j = u.hint("merge").join(v, same & (F.col("_ia") == F.col("_ib")) & (F.col("_ja") == F.col("_jb"))).select("ka", "pa", "kb", "pb").union(cold)
    return j.select(F.coalesce("ka", "kb").alias("key"), F.coalesce("pa", F.lit(NO_MATCH)).alias("a_pos"), F.coalesce("pb", F.lit(NO_MATCH)).alias("b_pos"))


def _part(by: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(by), F.col(parts)).cast("int")


def _copies(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _matched(x: DataFrame, y: DataFrame, kind: str, tasks: int) -> DataFrame:
    """(ka, pa, kb, pb) in so many tasks.  A full join holds all pairs of a key in memory, so
    it is made of a left one, which holds those of one row, and the rows it leaves out."""
    x, y, same = x.repartition(tasks, "ka"), y.repartition(tasks, "kb"), F.col("ka") == F.col("kb")
    if kind.replace("_", "").lower() not in ("full", "outer", "fullouter"):
        return x.hint("merge").join(y, same, kind).select("ka", "pa", "kb", "pb")
    left = x.hint("merge").join(y, same, "left").select("ka", "pa", "kb", "pb")
    return left.unionByName(y.hint("merge").join(x, same, "left_anti").select("kb", "pb"), allowMissingColumns=True)


def semi_join(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.join(b.select(key), key, "left_semi").select(*a.columns)


def anti_join(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.join(b.select(key), key, "left_anti").select(*a.columns)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row min(m, n) times."""
    return a.intersectAll(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row max(m - n, 0) times."""
    return a.exceptAll(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row |m - n| times; both sides are read and grouped once."""
    return _times(a, b, F.abs(F.col("_a") - F.col("_b")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row max(m, n) times: neither a plain nor a distinct union."""
    return _times(a, b, F.greatest("_a", "_b"))


def _times(a: DataFrame, b: DataFrame, n: Column) -> DataFrame:
    """Each distinct row of both sides ``n`` times, where _a and _b say how often it stands on each."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = a.select("*", one.alias("_a"), none.alias("_b")).union(b.select("*", none, one))
    each = both.groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).select(*a.columns, n.alias("_n"))
    return repeated(each, "_n", "_k", a.columns).select(*a.columns)


def _unshared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two sets that stand in one of them only."""
    return a.union(b).groupBy(*a.columns).agg(F.count("*").alias("_n")).filter("_n = 1").select(*a.columns)


SET_OPS = {"intersection": (DataFrame.intersect,), "union": (lambda a, b: a.union(b).distinct(),), "difference": (DataFrame.subtract,),
           "symmetric_difference": (_unshared,)}


def set_operation(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """The same operations where neither side has duplicates."""
    return SET_OPS[op][0](a, b)


def paired_sets(a: DataFrame, b: DataFrame, op: str, key: str = "key", pos: str = "pos") -> DataFrame:
    """(key, occ, side, pos): multiset operations by key that carry each row's position.

    The i-th occurrences of a key on both sides, by position, are partners and ``a`` stands
    for both; rows without a partner are the last ones of the longer side.
    """
    x = number_rows(a.select(key, pos), [pos], "occ", seg=key).select(F.col(key).alias("key"), "occ", F.col(pos).alias("pa"))
    y = number_rows(b.select(key, pos), [pos], "occ", seg=key).select(F.col(key).alias("key"), "occ", F.col(pos).alias("pb"))
    j = x.join(y, ["key", "occ"], "full")
    keep = {
        "intersection": "pa IS NOT NULL AND pb IS NOT NULL", "union": "true",
        "difference": "pb IS NULL", "symmetric_difference": "pa IS NULL OR pb IS NULL",
    }[op]
    side = F.when(F.col("pa").isNotNull(), "a").otherwise("b")
    return j.filter(keep).select("key", "occ", side.alias("side"), F.coalesce("pa", "pb").alias("pos"))


REDUCTIONS = {"sum": F.sum, "min": F.min, "max": F.max, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "product": F.product}


def reduce_all(df: DataFrame, value: str, ops: list[str]) -> DataFrame:
    """One row with each reduction of the column under its name."""
    return df.agg(*(REDUCTIONS[o](value).alias(o) for o in ops))


def reduce_with(df: DataFrame, value: str, reduce_: Callable[[str], Column], identity: object) -> DataFrame:
    """One row with ``value``: any aggregate over the column, ``identity`` where there is nothing to reduce."""
    return df.agg(F.coalesce(reduce_(value), F.lit(identity)).alias("value"))


def segmented_reduce(data: DataFrame, segments: DataFrame, seg: str, aggregate: Column, identity: object, to: str = "value") -> DataFrame:
    """(seg, to): each segment reduced; empty segments give ``identity``."""
    got = data.groupBy(seg).agg(aggregate.alias(to))
    return segments.select(seg).join(got, seg, "left").select(seg, F.coalesce(to, F.lit(identity)).alias(to))


def indirect_reduce(data: DataFrame, segments: DataFrame, seg: str, source: str, aggregate: Column, identity: object, to: str = "value") -> DataFrame:
    """(seg, to): segment i reduces the data of segment ``source``; a source may serve many."""
    got = data.groupBy(F.col(seg).alias(source)).agg(aggregate.alias(to))
    return segments.select(seg, source).join(got, source, "left").select(seg, F.coalesce(to, F.lit(identity)).alias(to))


PLUS_TIMES = (lambda m, x: m * x, F.sum, 0.0)
MIN_PLUS = (lambda m, x: m + x, F.min, None)


def spmv(matrix: DataFrame, x: DataFrame, rows: DataFrame | None = None, semiring=PLUS_TIMES, unary: bool = False) -> DataFrame:  # noqa: ANN001
    """(row, y): matrix (row, col, value) times vector x (col, x) over a semiring (multiply,
    add, identity).  ``unary`` adds x alone and reads no values.  Rows of ``rows`` (row)
    without elements give the identity."""
    times, plus, identity = semiring
    term = F.col("x") if unary else times(F.col("value"), F.col("x"))
    y = matrix.join(x, "col").groupBy("row").agg(plus(term).alias("y"))
    return y if rows is None else _all_rows(y, rows, identity)


def spmv_indirect(matrix: DataFrame, x: DataFrame, sources: DataFrame, semiring=PLUS_TIMES, unary: bool = False) -> DataFrame:  # noqa: ANN001
    """(row, y): row i of the result is row ``source`` of the matrix times x."""
    y = spmv(matrix, x, semiring=semiring, unary=unary).withColumnRenamed("row", "source")
    identity = semiring[2]
    return sources.select("row", "source").join(y, "source", "left").select("row", F.coalesce("y", F.lit(identity)).alias("y"))


def spgemm(a: DataFrame, b: DataFrame, block: int = BLOCK_PRODUCTS) -> DataFrame:
    """(row, col, value, n): the product of two sparse matrices, and how many products each element sums.
    Parallel elements are summed first, so no pair of them is formed twice.

    Beyond ``block`` products they are not moved to be summed: rows of ``a`` and columns of ``b`` are
    dealt out by hash in so many parts that each pair of parts gives about ``block`` products, and one
    task gets both parts' elements, forms the products and sums them."""
    add = lambda m: m.groupBy("row", "col").agg(F.sum("value").alias("value"), F.count("*").alias("k"))
    x = add(a).select(F.col("row"), F.col("col").alias("mid"), F.col("value").alias("va"), F.col("k").alias("ka"))
    y = add(b).select(F.col("row").alias("mid"), "col", F.col("value").alias("vb"), F.col("k").alias("kb"))
    term, pairs = F.sum(F.col("va") * F.col("vb")).alias("value"), F.sum(F.col("ka") * F.col("kb")).alias("n")
    if products(a, b).first().products <= block:
        return x.join(y, "mid").groupBy("row", "col").agg(term, pairs)
    ws = Workspace(a.sparkSession)
    (x, nx), (y, ny) = ws.counted(x.filter("mid IS NOT NULL"), "left"), ws.counted(y.filter("mid IS NOT NULL"), "right")
    count = products(x.select("row", F.col("mid").alias("col")), y.select(F.col("mid").alias("row"), "col")).first().products
    blocks = max(1, math.ceil(count / block))
    # Copies of elements are fewest where both sides' parts have as many of them.
    r = min(blocks, max(1, round(math.sqrt(blocks * nx / max(1, ny)))))
    c = math.ceil(blocks / r)
    part = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    u = x.select("mid", F.struct("row", "va", "ka").alias("_l"), part("row", r).alias("_i"), every(c).alias("_j"))
    v = y.select("mid", F.struct("col", "vb", "kb").alias("_r"), every(r).alias("_i"), part("col", c).alias("_j"))
    both = u.unionByName(v, allowMissingColumns=True).withColumn("_p", F.col("_i") * c + F.col("_j"))
    # Grouping by part and more keeps rows where they are, which a join on part and mid would not.
    lists = both.repartitionById(r * c, "_p").groupBy("_p", "mid").agg(F.collect_list("_l").alias("_l"), F.collect_list("_r").alias("_r"))
    each = lists.select("_p", "_r", F.explode("_l").alias("_l")).select("_p", "_l", F.explode("_r").alias("_r")).select("_p", "_l.*", "_r.*")
    return each.groupBy("_p", "row", "col").agg(term, pairs).drop("_p")


def products(a: DataFrame, b: DataFrame) -> DataFrame:
    """(products): scalar multiplications of the product, from degrees alone."""
    x = a.groupBy(F.col("col").alias("mid")).agg(F.count("*").alias("na"))
    y = b.groupBy(F.col("row").alias("mid")).agg(F.count("*").alias("nb"))
    return x.join(y, "mid").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("products"))


class PreparedSegments:
    """Segments laid out once, for many arrays: (pos, seg) is written bucketed by position,
    so applying it to an array of the same positions moves only that array."""

    def __init__(self, places: DataFrame, pos: str = "pos", seg: str = "seg") -> None:
        ws = Workspace(places.sparkSession)
        n = buckets_for(ws.spark, places.count())
        self.pos, self.seg = pos, seg
        self.places = ws.keep(places.select(pos, seg), "segments", pos, n, place=True)

    def apply(self, data: DataFrame, aggregate: Column, to: str = "value") -> DataFrame:
        """(seg, to) of an array (pos, ...)."""
        return self.places.join(data, self.pos).groupBy(self.seg).agg(aggregate.alias(to))


class PreparedMatrix:
    """A sparse matrix laid out once, for many vectors: bucketed by column, the elements of hot
    columns spread, so a product moves the vector and the partial sums of rows."""

    def __init__(self, matrix: DataFrame) -> None:
        ws = Workspace(matrix.sparkSession)
        elements, n = ws.counted(matrix.select(F.col("col").alias("src"), F.col("row").alias("dst"), F.col("value").alias("w")).filter("src IS NOT NULL"), "elements")
        self.layout = Layout(ws, elements, Along.OUT, n)
        ws.drop(elements)

    def apply(self, x: DataFrame, rows: DataFrame | None = None, semiring=PLUS_TIMES, unary: bool = False) -> DataFrame:  # noqa: ANN001
        times, plus, identity = semiring
        each = self.layout.join(x.select(F.col("col").alias("id"), "x"))
        y = each.groupBy(F.col("u").alias("row")).agg(plus(F.col("x") if unary else times(F.col("w"), F.col("x"))).alias("y"))
        return y if rows is None else _all_rows(y, rows, identity)


def _all_rows(y: DataFrame, rows: DataFrame, identity: object) -> DataFrame:
    return rows.select("row").join(y, "row", "left").select("row", F.coalesce("y", F.lit(identity)).alias("y"))


def column_ranges(matrix: DataFrame) -> DataFrame:
    """(row, first_col, last_col) of each row with elements."""
    return matrix.groupBy("row").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def strip_empty_rows(data: DataFrame, segments: DataFrame, seg: str) -> DataFrame:
    """Segments that have data."""
    return segments.join(data.select(seg).distinct(), seg, "left_semi")
