"""Most frequent values of a column in bounded memory (problem 1).

Each partition keeps a space-saving summary of at most ``counters`` values.  Summaries are
merged in a tree of fixed depth; the root gives every value that can reach the support, with
bounds on its count, and a second pass counts those candidates exactly.

A summary is held in its mergeable form: ``count`` is a lower bound, ``count + floor`` the
space-saving counter, an upper bound; a value without a counter occurred at most ``floor``
times.  Pruning subtracts the largest dropped count c from each kept one and adds c to the
floor, so floor * (counters + 1) never exceeds the rows seen, however the tree is shaped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUFFER = 1 << 17


class Summary:
    """At most ``counters`` values with lower bounds on their counts."""

    def __init__(self, kind: pa.DataType, counters: int) -> None:
        self.k, self.floor, self.total = counters, 0, 0
        self.values, self.counts = pa.array([], kind), np.array([], np.int64)

    def add(self, values: pa.Array, counts: np.ndarray | None = None) -> None:
        """Add values, each ``counts`` times (once without); nulls must be gone."""
        if counts is None:
            if not len(values):
                return
            seen = values.value_counts()
            values, counts = seen.field("values"), seen.field("counts").to_numpy()
        both = pa.table({"v": pa.concat_arrays([self.values, values]), "n": np.concatenate([self.counts, counts])})
        merged = both.group_by("v").aggregate([("n", "sum")])
        self.values, self.counts = merged["v"].combine_chunks(), merged["n_sum"].to_numpy().astype(np.int64)
        if isinstance(self.values, pa.ChunkedArray):
            self.values = pa.concat_arrays(self.values.chunks)
        if len(self.counts) > self.k:
            cut = int(np.partition(self.counts, -self.k - 1)[-self.k - 1])
            stay = self.counts > cut
            self.values, self.counts = self.values.filter(pa.array(stay)), self.counts[stay] - cut
            self.floor += cut

    def rows(self, node: int) -> pa.RecordBatch:
        """One row for each counter, after a row without a value that has the floor and the total."""
        n = len(self.counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, node, np.int64)),
                pa.concat_arrays([pa.nulls(1, self.values.type), self.values]),
                pa.array(np.concatenate([[0], self.counts]).astype(np.int64)),
                pa.array(np.concatenate([[self.floor], np.zeros(n)]).astype(np.int64)),
                pa.array(np.concatenate([[self.total], np.zeros(n)]).astype(np.int64)),
            ],
            names=["node", "item", "count", "floor", "total"],
        )


def summaries(df: DataFrame, column: str, counters: int) -> DataFrame:
    """(node, item, count, floor, total): the summary of each partition of ``df``."""
    kind = df.schema[column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        summary, waiting, size = None, [], 0
        for b in batches:
            col = b.column(0)
            summary = summary or Summary(col.type, counters)
            col = col.drop_null()
            summary.total += len(col)
            waiting.append(col)
            size += len(col)
            if size >= BUFFER:
                summary.add(pa.concat_arrays(waiting))
                waiting, size = [], 0
        if summary:
            summary.add(pa.concat_arrays(waiting) if waiting else summary.values[:0])
            yield summary.rows(TaskContext.get().partitionId())

    return df.select(F.col(f"`{column}`").alias("item")).mapInArrow(run, _schema(kind))


def _schema(kind: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("node", long), T.StructField("item", kind), *(T.StructField(c, long) for c in ("count", "floor", "total"))])


def merge_level(nodes: DataFrame, fan_in: int | None, counters: int) -> DataFrame:
    """Merge ``fan_in`` summaries each into one; None merges all that are left."""
    up = F.floor(F.col("node") / fan_in).cast("bigint") if fan_in else F.lit(0).cast("bigint")

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        s = Summary(t.schema.field("item").type, counters)
        head = pc.is_null(t["item"])
        s.floor, s.total = pc.sum(t["floor"]).as_py(), pc.sum(t["total"]).as_py()
        body = t.filter(pc.invert(head)).combine_chunks()
        if body.num_rows:
            chunks = body["item"].chunks
            s.add(pa.concat_arrays(chunks), body["count"].to_numpy())
        return pa.Table.from_batches([s.rows(key[0].as_py())])

    return nodes.withColumn("node", up).groupBy("node").applyInArrow(merge, nodes.schema)


def candidates(df: DataFrame, column: str, support: Fraction | str | float, slack: int = 4, fan_in: int = 64) -> DataFrame:
    """(item, lower, upper, total): every value that can occur in at least ``support`` of the
    non-null rows, with bounds on its count; at most slack / support rows.

    Two levels of ``fan_in`` and a root: a million partitions leave 245 summaries for the root.
    """
    counters = ceil(slack / Fraction(support))
    nodes = summaries(df, column, counters)
    for f in (fan_in, fan_in, None):
        nodes = merge_level(nodes, f, counters)
    share = Fraction(support)

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The root is one group, so its rows come together, the head first.
        floor = total = 0
        for b in batches:
            t = pa.table(b).drop_columns(["node"])
            head = t.filter(pc.is_null(t["item"]))
            floor, total = floor + (pc.sum(head["floor"]).as_py() or 0), total + (pc.sum(head["total"]).as_py() or 0)
            t = t.filter(pc.is_valid(t["item"]))
            upper = pc.add(t["count"], floor)
            least = ceil(share * total)
            t = pa.table({"item": t["item"], "lower": t["count"], "upper": upper, "total": pa.array(np.full(len(t), total, np.int64))})
            yield from t.filter(pc.greater_equal(t["upper"], least)).to_batches()

    long = T.LongType()
    kind = df.schema[column].dataType
    return nodes.mapInArrow(survive, T.StructType([T.StructField("item", kind), *(T.StructField(c, long) for c in ("lower", "upper", "total"))]))


def frequent_items(df: DataFrame, column: str, support: Fraction | str | float, slack: int = 4) -> DataFrame:
    """(item, n, lower, upper): each value in at least ``support`` of the rows with a non-null
    value, its exact count, and the bounds the summaries gave.

    Rows count as they stand, repeated ones too; nulls count nowhere; ties are all returned;
    an empty or all-null column gives no rows.  Memory of each task: ``slack / support``
    counters and a buffer of 128 Ki values.  The candidates, at most slack / support rows
    whatever the input's size, are broadcast to the second pass.
    """
    found = F.broadcast(candidates(df, column, support, slack))
    share = Fraction(support)
    values = df.select(F.col(f"`{column}`").alias("item")).filter("item IS NOT NULL")
    counted = values.join(found, "item").groupBy("item", "lower", "upper", "total").agg(F.count("*").alias("n"))
    enough = F.col("n").cast("decimal(38,0)") * share.denominator >= F.col("total").cast("decimal(38,0)") * share.numerator
    return counted.filter(enough).select("item", "n", "lower", "upper")
