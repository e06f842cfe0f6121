"""Per-key results when a few keys hold most records (problem 2).

Rows are compressed to value frequencies: they are grouped by key *and* value before they
are grouped by key.  The first grouping spreads a hot key over all tasks by its values and
combines on the map side; the second sees each value once, with its weight.  Counts, sums,
distinct counts and modes follow from the weighted values by plain, map-side combined
aggregates.  Percentiles need the values of a key in order: they come from a range-partitioned
running sum, in which a hot key spans many partitions.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.scan import running_total
from weftgraph.session import Workspace


def value_frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, w): how often each value, null too, stands under each non-null key."""
    k, v = F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")
    return df.select(k, v).filter("key IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("w"))


def keyed_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, n_value, value_sum, n_distinct, mode, mode_n) for each non-null key.

    n counts rows as they stand, repeated ones too; n_value those with a non-null value;
    value_sum is null when there is none.  mode is the most frequent value, of ties the
    smallest.  Works on any orderable numeric value; an empty table gives no rows.
    """
    f = value_frequencies(df, key, value)
    real = F.col("value").isNotNull()
    rank = F.when(real, F.struct("w", (-F.col("value")).alias("down")))
    best = F.max(rank)
    return f.groupBy("key").agg(
        F.sum("w").alias("n"),
        F.coalesce(F.sum(F.when(real, F.col("w"))), F.lit(0)).alias("n_value"),
        F.sum(F.col("value") * F.col("w")).alias("value_sum"),
        F.count("value").alias("n_distinct"),
        (-best["down"]).alias("mode"),
        best["w"].alias("mode_n"),
    )


def heavy_keys(df: DataFrame, key: str, value: str, share: Fraction | str) -> DataFrame:
    """keyed_stats of the keys that hold at least ``share`` of the rows with a non-null key."""
    s = Fraction(share)
    stats = keyed_stats(df, key, value)
    total = df.select(F.col(f"`{key}`").alias("key")).filter("key IS NOT NULL").agg(F.count("*").alias("t"))
    enough = F.col("n").cast("decimal(38,0)") * s.denominator >= total.scalar().cast("decimal(38,0)") * s.numerator
    return stats.filter(enough)


def keyed_percentiles(df: DataFrame, key: str, value: str, shares: list[Fraction | str], parts: int | None = None) -> DataFrame:
    """(key, p0, p1, ...): for each share, the smallest value of the key such that at least
    that share of its non-null values is not larger (the inverted distribution function).

    Exact.  No task holds a key: weighted values are range-partitioned by (key, value), so a
    hot key spans as many partitions as its distinct values fill.
    """
    ws = Workspace(df.sparkSession)
    f = ws.keep(value_frequencies(df, key, value).filter("value IS NOT NULL"), "frequencies")
    run = running_total(ws, f, "key", "value", "w", parts)  # with the total of the key, which came from one row for each range
    out = []
    for k, share in enumerate(shares):
        s = Fraction(share)
        reached = F.col("running") * s.denominator >= F.col("total") * s.numerator
        out.append(F.min(F.when(reached, F.col("value"))).alias(f"p{k}"))
    return run.groupBy("key").agg(*out)


def segment_counts(offsets: DataFrame, owner: str, seg: str, offset: str) -> DataFrame:
    """(owner, seg, n) of each segment, from rows of offsets of which the last of each owner
    holds the total.  Neighbouring offsets meet in an equi-join on (owner, seg), not in a
    window over an owner, so an owner with a third of all segments is spread."""
    o = offsets.select(F.col(f"`{owner}`").alias("owner"), F.col(f"`{seg}`").alias("seg"), F.col(f"`{offset}`").alias("at")).distinct()
    nxt = o.select("owner", (F.col("seg") - 1).alias("seg"), F.col("at").alias("end"))
    return o.join(nxt, ["owner", "seg"]).select("owner", "seg", (F.col("end") - F.col("at")).alias("n"))
