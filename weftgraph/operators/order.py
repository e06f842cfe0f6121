"""Ordered arrays: numbering, sorting, merging, searching and run-wise operators.

An array is a DataFrame with an explicit position column.  Global positions come from a
range partitioning by the order and a prefix sum over partition sizes, never from a window
over everything in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.scan import ranges, scan, segments_from_flags
from weftgraph.session import Workspace


#: A row that is repeated more often is cut into blocks of so many copies.
BLOCK = 65_536
Order = Callable[[Column], Column]


def repeated(df: DataFrame, count: str, to: str, by: str | list[str]) -> DataFrame:
    """Each row as often as ``count`` says, with ``to``: 0, 1, ... count - 1; no row for none.

    Copies are made in blocks of bounded length, which are sent to tasks by the hash of ``by``
    and the block's number, so one row of very many copies is neither one array nor one task's work.
    """
    n, block = F.col(count).cast("bigint"), F.lit(BLOCK).cast("bigint")
    cut = df.filter(n > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block).cast("bigint"))))
    spread = cut.repartition(*([by] if isinstance(by, str) else by), "_block")
    first = F.col("_block") * block
    return spread.withColumn(to, F.explode(F.sequence(first, F.least(n, first + block) - 1))).drop("_block")


def _ordered(key: str, order: Order | None) -> Column:
    """The key as it is sorted: ascending, or as ``order`` makes of it, such as ``Column.desc`` or another expression of it."""
    return order(F.col(key)) if order else F.col(key).asc()


def number_rows(df: DataFrame, by: list[str | Column], to: str = "pos", seg: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``to``: 0, 1, ... in the order of ``by``, from 0 again in each ``seg``.

    Equal rows get different numbers.  A segment may be of any size.
    """
    ws = Workspace(df.sparkSession)
    t = ranges(ws, df, [seg, *by] if seg else by, parts)
    keys = ["_part", seg] if seg else ["_part"]
    sizes = t.groupBy(*keys).agg(F.count("*").alias("_n"))
    outer = (W.partitionBy(seg) if seg else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*keys, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    own = t.withColumn("_own", F.row_number().over(W.partitionBy(*keys).orderBy(*by)) - 1).alias("t")
    same = F.col("t._part") == F.col("g._part")
    if seg:
        same &= F.col(f"t.{seg}").eqNullSafe(F.col(f"g.{seg}"))
    both = own.join(before.alias("g"), same).select("t.*", "g._before")
    return both.select(*[c for c in df.columns if c != to], (F.col("_own") + F.col("_before")).cast("bigint").alias(to))


def shifted(df: DataFrame, pos: str, value: str, to: str, parts: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """``df`` with ``to``: the value of the row before by ``pos``, and ``to``_none, true for the first row."""
    ws = ws or Workspace(df.sparkSession)
    t = ranges(ws, df, [pos], parts)
    ends = t.groupBy("_part").agg(F.max_by(F.struct(F.col(value).alias("x")), pos).alias("_last"))
    carried = ends.select("_part", F.lag("_last").over(W.partitionBy(F.lit(0)).orderBy("_part")).alias("_carried"))
    own = t.withColumn("_own", F.lag(F.struct(F.col(value).alias("x"))).over(W.partitionBy("_part").orderBy(pos)))
    both = own.join(carried, "_part", "left").withColumn("_prev", F.coalesce("_own", "_carried"))
    return both.select(*df.columns, F.col("_prev.x").alias(to), F.col("_prev").isNull().alias(f"{to}_none"))


def adjacent_difference(df: DataFrame, pos: str, value: str, to: str = "diff") -> DataFrame:
    """``to``: value minus the value before; the first row keeps its value."""
    s = shifted(df, pos, value, "_before")
    return s.select(*df.columns, F.when(F.col("_before_none"), F.col(value)).otherwise(F.col(value) - F.col("_before")).alias(to))


def starts_run(key: str) -> Column:
    return F.col("_before_none") | ~F.col(key).eqNullSafe(F.col("_before"))


def consecutive_removal(df: DataFrame, pos: str, key: str) -> DataFrame:
    """Rows whose key differs from the one before; nulls equal each other."""
    return shifted(df, pos, key, "_before").filter(starts_run(key)).select(*df.columns)


def runs(df: DataFrame, pos: str, key: str, to: str = "run") -> DataFrame:
    """``df`` with the number, from 0, of its run of consecutive equal keys."""
    flagged = shifted(df, pos, key, "_before").select(*df.columns, starts_run(key).alias("_starts"))
    s = segments_from_flags(flagged, pos, "_starts", "_run1")
    return s.select(*df.columns, (F.col("_run1") - 1).alias(to))


def reduce_by_run(df: DataFrame, pos: str, key: str, aggregate: Column, to: str = "value") -> DataFrame:
    """(run, key, to): consecutive equal keys reduced; a key that comes back later is another run."""
    return runs(df, pos, key, "_run").groupBy(F.col("_run").alias("run"), F.col(key).alias("key")).agg(aggregate.alias(to))


def copy_if(df: DataFrame, condition: Column | str, pos: str | None = None) -> DataFrame:
    """Rows that pass, in order; renumbered from 0 where ``pos`` is given."""
    kept = df.filter(condition)
    return number_rows(kept, [pos], "new_pos") if pos else kept


def bulk_remove(df: DataFrame, pos: str, positions: DataFrame, at: str = "pos") -> DataFrame:
    """``df`` without the rows at the given positions, with ``new_pos`` from 0."""
    drop = positions.select(F.col(at).alias(pos)).distinct()
    return number_rows(df.join(drop, pos, "left_anti").select(*df.columns), [pos], "new_pos")


def bulk_insert(a: DataFrame, b: DataFrame) -> DataFrame:
    """(new_pos, side, pos, val): row (pos, at, val) of ``a`` goes before row ``at`` of ``b``
    (pos, val); inserts at one place keep their order."""
    left = a.select(F.col("at").alias("_at"), F.lit(0).alias("_side"), "pos", "val")
    right = b.select(F.col("pos").alias("_at"), F.lit(1).alias("_side"), "pos", "val")
    n = number_rows(left.unionByName(right), ["_at", "_side", "pos"], "new_pos")
    return n.select("new_pos", F.when(F.col("_side") == 0, "a").otherwise("b").alias("side"), "pos", "val")


def sort_keys(df: DataFrame, key: str, pos: str, to: str = "rank", order: Order | None = None) -> DataFrame:
    """Stable sort: ``to`` is each row's place by (key, pos); with the row's payload and its
    position it is the pair sort and the argsort too.  ``order`` compares keys otherwise.
    Nearly sorted input needs no sort of its own: the sort inside tasks takes runs as they are."""
    return number_rows(df, [_ordered(key, order), pos], to)


def segmented_sort(df: DataFrame, seg: str, key: str, pos: str, to: str = "rank", order: Order | None = None) -> DataFrame:
    """Stable sort inside each segment; ``to`` counts from 0 in each."""
    return number_rows(df, [_ordered(key, order), pos], to, seg=seg)


def segments_from_starts(df: DataFrame, pos: str, starts: DataFrame, start: str = "start", to: str = "seg") -> DataFrame:
    """``df`` with the number of its segment, from the first positions of all segments but
    an implied one at 0, which are merged into the order and counted."""
    marks = starts.select(F.col(start).alias(pos)).distinct().filter(F.col(pos) > 0).withColumn("_mark", F.lit(1))
    flagged = df.join(marks, pos, "left")
    return scan(flagged, pos, "_mark", to=to).select(*df.columns, F.col(to).cast("bigint").alias(to))


def radix_sort(df: DataFrame, key: str, pos: str, begin_bit: int = 0, end_bit: int = 64, to: str = "rank") -> DataFrame:
    """Stable sort by bits begin_bit to end_bit - 1 of an integer key taken as unsigned."""
    width = end_bit - begin_bit
    digit = F.shiftrightunsigned(F.col(key).cast("bigint"), begin_bit)
    if width < 64:
        digit = digit.bitwiseAND(F.lit((1 << width) - 1))
        return number_rows(df.withColumn("_digit", digit), ["_digit", pos], to).drop("_digit")
    by = [F.col(key).cast("bigint") < 0, digit]
    return number_rows(df.withColumn("_sign", by[0]).withColumn("_digit", by[1]), ["_sign", "_digit", pos], to).drop("_sign", "_digit")


def merge(a: DataFrame, b: DataFrame, key: str = "key", pos: str = "pos", order: Order | None = None) -> DataFrame:
    """(new_pos, side, pos, key ...): stable merge; of equal keys those of ``a`` come first."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    n = number_rows(both, [_ordered(key, order), "_side", pos], "new_pos")
    return n.withColumn("side", F.when(F.col("_side") == 0, "a").otherwise("b")).drop("_side")


def sorted_search(a: DataFrame, b: DataFrame, upper: bool = False, key: str = "key", pos: str = "pos", order: Order | None = None) -> DataFrame:
    """(pos, key, index): for each row of ``a``, how many keys of ``b`` are smaller (lower
    bound), or not larger (upper bound).  Null keys are left out on both sides.  ``order`` may
    compare keys otherwise, but must keep different keys apart."""
    tag = 0 if upper else 1
    x = a.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(0).alias("is_b"), F.lit(1 - tag).alias("tag"), F.col(pos).alias("pos"))
    # Keys of b meet already counted, so a key that fills b is one row.
    y = b.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("is_b")).select("key", "is_b", F.lit(tag).alias("tag"), F.lit(-1).cast("bigint").alias("pos"))
    s = scan(x.unionByName(y), [_ordered("key", order), "tag", "pos"], "is_b", to="index")
    return s.filter(F.col("pos") >= 0).select("pos", "key", F.col("index").cast("bigint").alias("index"))


def search_match(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """``a`` with ``match``: whether its key stands in ``b``."""
    keys = b.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_m", F.lit(True))
    return a.join(keys, a[key] == F.col("_k"), "left").select(*a.columns, F.coalesce("_m", F.lit(False)).alias("match"))


def search_both(a: DataFrame, b: DataFrame, upper: bool = False, key: str = "key", pos: str = "pos", order: Order | None = None) -> DataFrame:
    """(side, pos, key, index, match): sorted_search of ``a`` in ``b``, and of ``b`` in ``a`` by
    the other bound, so that both sides' indices describe one merged order; ``match``: whether
    the key stands on the other side."""
    out = []
    for side, x, y, bound in (("a", a, b, upper), ("b", b, a, not upper)):
        keys = y.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_m", F.lit(True))
        s = sorted_search(x, y, bound, key, pos, order).join(keys, F.col("key") == F.col("_k"), "left")
        out.append(s.select(F.lit(side).alias("side"), "pos", "key", "index", F.coalesce("_m", F.lit(False)).alias("match")))
    return out[0].union(out[1])


def match_counts(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """(a_matches, b_matches): rows of each side whose key stands on the other."""
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(key, F.lit(0), F.lit(1)))
    each = both.filter("k IS NOT NULL").groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).filter("x > 0 AND y > 0")
    return each.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("a_matches"), F.coalesce(F.sum("y"), F.lit(0)).alias("b_matches"))


def equality_count(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """``a`` with ``n``: how often its key stands in ``b``."""
    counts = b.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return a.join(counts, a[key] == F.col("_k"), "left").select(*a.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


def load_balance(df: DataFrame, pos: str, count: str) -> DataFrame:
    """(item, owner, rank): work items numbered in order of position, each with the position
    that made it and its rank there; rows of no count make none."""
    s = scan(df, pos, count, inclusive=False, to="_from")
    each = repeated(s.select(F.col(pos).alias("owner"), "_from", F.col(count).alias("_n")), "_n", "rank", "owner")
    return each.select((F.col("_from") + F.col("rank")).cast("bigint").alias("item"), "owner", "rank")


def interval_expand(df: DataFrame, pos: str, count: str, value: str) -> DataFrame:
    """(item, value): each value repeated ``count`` times, in order of position."""
    s = scan(df, pos, count, inclusive=False, to="_from")
    each = repeated(s.select(F.col(pos).alias("_pos"), F.col(value).alias("value"), "_from", F.col(count).alias("_n")), "_n", "k", "_pos")
    return each.select((F.col("_from") + F.col("k")).cast("bigint").alias("item"), "value")


def interval_move(intervals: DataFrame, source: DataFrame, gather: bool = True, scatter: bool = True, pos: str = "pos", value: str = "val") -> DataFrame:
    """(to, val): interval (pos, gather, scatter, count) copies ``count`` values of ``source``
    from place ``gather`` on to place ``scatter`` on.

    Without ``gather`` intervals read one after the other, without ``scatter`` they write so;
    their columns are then not needed.  Intervals without a count copy nothing.
    """
    s = intervals
    if not (gather and scatter):
        s = scan(s, pos, "count", inclusive=False, to="_run")
    read = F.col("gather") if gather else F.col("_run")
    write = F.col("scatter") if scatter else F.col("_run")
    each = repeated(s.select(F.col(pos).alias("_pos"), read.alias("_r"), write.alias("_w"), "count"), "count", "_k", "_pos")
    moved = each.select((F.col("_r") + F.col("_k")).alias("_r"), (F.col("_w") + F.col("_k")).cast("bigint").alias("to"))
    return moved.join(source.select(F.col(pos).alias("_r"), F.col(value).alias("val")), "_r").select("to", "val")


def gather_values(index: DataFrame, source: DataFrame, pos: str = "pos", at: str = "at", value: str = "val") -> DataFrame:
    """(pos, val): the value of ``source`` at place ``at`` of each row."""
    src = source.select(F.col(pos).alias("_p"), F.col(value).alias("val"))
    return index.select(pos, at).join(src, F.col(at) == F.col("_p")).select(pos, "val")


def scatter_values(data: DataFrame, pos: str = "pos", at: str = "at", value: str = "val", condition: Column | None = None) -> DataFrame:
    """(pos, val): each value at place ``at``; where several go to one place, the last by position stays."""
    d = data.filter(condition) if condition is not None else data
    return d.groupBy(F.col(at).alias("pos")).agg(F.max_by(value, pos).alias("val"))
