"""Joins in which one key may hold a third of all rows.

Keys with more than 1 / SHARE of the rows, of which there are fewer than SHARE, are counted on
the map side and broadcast.  Their rows are spread over so many parts as their number needs, and
each part meets a copy of the other side's row.  All other rows are joined as ever, in the same
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 10_000
#: Rows that one task takes in any case: below that many in all, no key has to be spread.
TASK_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str | list[str], rows: int, share: int = SHARE) -> DataFrame:
    """(key, _parts): the keys with more than rows / share rows, fewer than ``share``, and in how many parts each is split."""
    keys = [key] if isinstance(key, str) else key
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") * share > rows)
    return n.select(*keys, F.ceil(F.col("_n") * share / F.lit(max(1, rows))).cast("int").alias("_parts"))


def spread_join(
    big: DataFrame, small: DataFrame, key: str | list[str], by: str, rows: int, how: str = "inner", task_rows: int = TASK_ROWS, share: int = SHARE, hot: DataFrame | None = None
) -> DataFrame:
    """``big`` joined with ``small``, which holds each key at most a few times, on the columns
    ``key`` (its rows are copied to each part); ``how`` is inner, left or left_semi.  Rows of one hot key in ``big`` are spread by the
    hash of ``by``.  ``rows`` is the number of rows of ``big``; ``hot`` its hot_keys, if known.
    Null keys match nothing."""
    keys = [key] if isinstance(key, str) else key
    if rows <= task_rows:
        return big.join(small, keys, how)
    few = F.broadcast(hot if hot is not None else hot_keys(big, keys, rows, share))
    parts = F.col("_parts")
    spread = big.join(few, keys, "left").withColumn("_salt", F.when(parts.isNull(), 0).otherwise(F.pmod(F.xxhash64(by), parts).cast("int"))).drop("_parts")
    copies = small.join(few, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop("_parts")
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
