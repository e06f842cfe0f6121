"""Graphs and arrays made from a seed. Weights are 1; every random value follows from row number and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph


def uniform(row: Column, seed: int, k: int = 0) -> Column:
    """A number in [0, 1) that depends on the row number alone, so retried tasks repeat it."""
    return (F.shiftrightunsigned(F.xxhash64(row, F.lit(seed), F.lit(k)), 11).cast("double")) / float(1 << 53)


def below(row: Column, n: int, seed: int, k: int = 0) -> Column:
    return F.least(F.floor(uniform(row, seed, k) * n), F.lit(n - 1)).cast("bigint")


def _graph(spark: SparkSession, n: int, edges: DataFrame, undirected: bool = False) -> Graph:
    g = Graph.of(spark.range(n).select("id"), edges)
    return g.both_ways() if undirected else g


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 0, undirected: bool = False) -> Graph:
    """m edges between uniformly drawn vertices; loops and parallel edges may occur."""
    i = F.col("id")
    return _graph(spark, n, spark.range(m).select(below(i, n, seed, 0).alias("src"), below(i, n, seed, 1).alias("dst")), undirected)


def rmat(spark: SparkSession, n: int, m: int, a: float = 0.45, b: float = 0.15, c: float = 0.15, d: float = 0.25, seed: int = 0, undirected: bool = False) -> Graph:
    """m edges placed by recursive choice of quadrants with probabilities a, b, c, d, varied by
    up to 5 % on each level and normalised again; n is rounded up to a power of two inside
    and ids are folded back into 0..n-1."""
    levels, i = max(1, (n - 1).bit_length()), F.col("id")
    e, k = spark.range(m), 0
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for level in range(levels):
        noisy = [p * (0.95 + 0.1 * uniform(i, seed, 10 * level + k + 1)) for k, p in enumerate((a, b, c, d))]
        total = noisy[0] + noisy[1] + noisy[2] + noisy[3]
        at = uniform(i, seed, 10 * level) * total
        bit = 1 << (levels - 1 - level)
        down, right = at >= noisy[0] + noisy[1], ((at >= noisy[0]) & (at < noisy[0] + noisy[1])) | (at >= noisy[0] + noisy[1] + noisy[2])
        src, dst = src + F.when(down, bit).otherwise(0), dst + F.when(right, bit).otherwise(0)
    return _graph(spark, n, e.select((src % n).alias("src"), (dst % n).alias("dst")), undirected)


def _grid(spark: SparkSession, width: int, dims: int) -> Graph:
    n, i = width**dims, F.col("id")
    steps = [F.struct(F.lit(0).cast("bigint").alias("by"), F.lit(True).alias("ok"))]
    for k in range(dims):
        place = F.floor(i / width**k) % width
        steps += [F.struct(F.lit(-(width**k)).cast("bigint").alias("by"), (place > 0).alias("ok")), F.struct(F.lit(width**k).cast("bigint").alias("by"), (place < width - 1).alias("ok"))]
    e = spark.range(n).select(i, F.explode(F.array(*steps)).alias("s")).filter("s.ok")
    return _graph(spark, n, e.select(i.alias("src"), (i + F.col("s.by")).alias("dst")))


def grid2d(spark: SparkSession, width: int) -> Graph:
    """width x width vertices, each linked with itself and its neighbours left, right, above and below."""
    return _grid(spark, width, 2)


def grid3d(spark: SparkSession, width: int) -> Graph:
    """width^3 vertices, each linked with itself and its six neighbours."""
    return _grid(spark, width, 3)


def regularish(spark: SparkSession, n: int, degree: int, seed: int = 0) -> Graph:
    """Each vertex has exactly ``degree`` uniformly drawn out-neighbours."""
    e = spark.range(n * degree).select(F.floor(F.col("id") / degree).alias("src"), below(F.col("id"), n, seed).alias("dst"))
    return _graph(spark, n, e)


def random_array(spark: SparkSession, n: int, low: int, high: int, seed: int = 0, ordered: bool = False) -> DataFrame:
    """(pos, val): whole numbers from low to high; ``ordered``: the same, sorted."""
    a = spark.range(n).select(F.col("id").alias("pos"), (below(F.col("id"), high - low + 1, seed) + low).alias("val"))
    if not ordered:
        return a
    from weftgraph.operators.order import number_rows

    return number_rows(a, ["val", "pos"], "rank").select(F.col("rank").alias("pos"), "val")
