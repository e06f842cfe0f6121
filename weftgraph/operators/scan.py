"""Prefix reductions: whole, segmented, and in two levels for inputs of any size.

A window without partitions runs in one task.  Here the input is range-partitioned by its
order once and written with its partition number; partitions are reduced, the reductions
(one row for each partition and group) get their prefixes, and each partition scans its own
rows from its prefix on.  The written partition numbers make this safe to recompute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import Workspace

#: Reductions that can be scanned: how to reduce rows, and how to combine two results.  Any other
#: associative reduction may be given as such a pair.
OPS = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "bit_or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "bit_and": (F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def ranges(ws: Workspace, df: DataFrame, by: list[str | Column], parts: int | None) -> DataFrame:
    """``df`` range-partitioned and written, with the number of each row's partition in ``_part``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ws.keep(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "ranges")


def running_total(ws: Workspace, df: DataFrame, key: str, order: str, weight: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``running``: the sum of ``weight`` over the rows of the same key up to this
    one by ``order``, whose values must be distinct in a key, and ``total``: that of all its rows."""
    t = ranges(ws, df, [key, order], parts)
    sums = t.groupBy("_part", key).agg(F.sum(weight).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(weight).over(W.partitionBy("_part", key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("_sum").over(W.partitionBy(key)).alias("total")
    both = t.withColumn("_own", own).join(sums.select("_part", key, before.alias("_before"), whole), ["_part", key])
    return both.select(*df.columns, (F.col("_own") + F.col("_before")).alias("running"), "total")


def scan(
    df: DataFrame, pos: str | list[str | Column], value: str, op: str | tuple[Callable, Callable] = "sum", inclusive: bool = True, identity: object = 0,
    seg: str | None = None, to: str = "scan", parts: int | None = None, ws: Workspace | None = None,
) -> DataFrame:
    """``df`` with ``to``: the reduction of ``value`` over all rows up to this one by ``pos``
    (before this one, if not inclusive), restarted in each segment where ``seg`` is given.

    Positions must be distinct (in a segment).  Where nothing comes before, and where all
    values so far are null, the result is ``identity``.  An empty table stays empty.
    """
    reduce_, combine = OPS[op] if isinstance(op, str) else op
    ws = ws or Workspace(df.sparkSession)
    order = [pos] if isinstance(pos, str) else pos
    by = [seg, *order] if seg else order
    t = ranges(ws, df, by, parts)
    keys = ["_part", *([seg] if seg else [])]
    none = F.lit(identity)
    groups = t.groupBy(*keys).agg(reduce_(value).alias("_all"))
    outer = (W.partitionBy(seg) if seg else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = groups.select(*keys, reduce_("_all").over(outer).alias("_before"))
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    same = F.col("t._part") == F.col("g._part")
    if seg:
        same &= F.col(f"t.{seg}").eqNullSafe(F.col(f"g.{seg}"))
    own = t.withColumn("_own", reduce_(value).over(frame)).alias("t")
    both = own.join(before.alias("g"), same, "left").select("t.*", "g._before")
    value_: Column = F.coalesce(
        F.when(F.col("_own").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_own")).otherwise(combine(F.col("_before"), F.col("_own"))), none
    )
    return both.select(*[c for c in df.columns if c != to], value_.alias(to))


def scan_with_total(df: DataFrame, pos: str, value: str, op: str | tuple[Callable, Callable] = "sum", identity: object = 0, **options: object) -> tuple[DataFrame, DataFrame]:
    """(``scan``, one row with ``total``): the reduction of all values too, ``identity`` where there is none."""
    reduce_ = (OPS[op] if isinstance(op, str) else op)[0]
    return scan(df, pos, value, op, identity=identity, **options), df.agg(F.coalesce(reduce_(value), F.lit(identity)).alias("total"))


def segments_from_flags(df: DataFrame, pos: str, flag: str, to: str = "seg") -> DataFrame:
    """``df`` with a segment number that rises by one at each row whose ``flag`` is true."""
    f = df.withColumn("_flag", F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    return scan(f, pos, "_flag", to=to).drop("_flag")


def max_scan(df: DataFrame, pos: str, value: str, to: str = "scan") -> DataFrame:
    """The largest value so far; null until the first value: fills forward where values rise."""
    return scan(df, pos, value, "max", identity=None, to=to)
