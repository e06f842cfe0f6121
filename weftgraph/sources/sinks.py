"""Writers of graph, matrix and result files.

Text formats are written as the ordered parts of a folder, each by its own task; readers take
such a folder as one text.  ``join_parts`` makes one file of it, outside of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph

FORMATS = {"level": "%d", "component": "%d", "dist": "%d", "rank": "%f"}


def _in_order(lines: DataFrame, order: list, path: str) -> None:
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, path: str, to: str) -> None:
    """One file ``to`` of the ordered parts in the folder ``path``: streamed by the file system's
    client in pieces of a few KB, whatever the size."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    folder, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = folder.getFileSystem(conf)
    parts = sorted(str(x.getPath()) for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for p in parts:
            source = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    finally:
        out.close()


def write_values(values: DataFrame, column: str, path: str) -> None:
    """One value a line, in order of id, without the id."""
    _in_order(values.select("id", F.format_string(FORMATS.get(column, "%s"), column).alias("line")), ["id"], path)


def write_parquet(values: DataFrame, path: str) -> None:
    values.write.mode("overwrite").parquet(path)


def write_metis(graph: Graph, path: str) -> None:
    """Header ``n m`` (m: edges / 2, as each is listed from both ends), then the 1-based neighbours of each vertex."""
    n, m = graph.vertices.count(), graph.edges.count()
    near = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.col("dst") + 1)).alias("near"))
    text = F.coalesce(F.concat_ws(" ", F.transform("near", lambda x: x.cast("string"))), F.lit(""))
    body = graph.vertices.join(near, "id", "left").select("id", text.alias("line"))
    head = graph.vertices.sparkSession.createDataFrame([(-1, f"{n} {m // 2}")], "id bigint, line string")
    _in_order(head.union(body), ["id"], path)


def write_market(matrix: DataFrame, height: int, width: int, path: str, pattern: bool = False) -> None:
    """(row, col, value), 0-based, as a general Matrix Market coordinate file."""
    place = [(F.col(c) + 1).cast("string") for c in ("row", "col")]
    line: Column = F.concat_ws(" ", *place, *([] if pattern else [F.col("value").cast("string")]))
    head = [f"%%MatrixMarket matrix coordinate {'pattern' if pattern else 'real'} general", f"{height} {width} {matrix.count()}"]
    top = matrix.sparkSession.createDataFrame([(k - len(head), 0, x) for k, x in enumerate(head)], "row bigint, col bigint, line string")
    _in_order(top.union(matrix.select("row", "col", line.alias("line"))), ["row", "col"], path)


def write_dimacs(graph: Graph, path: str) -> None:
    """``p sp n m``, then an arc ``a u v w`` a line, 1-based."""
    arc = F.concat_ws(" ", F.lit("a"), (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.col("w").cast("string"))
    head = graph.vertices.sparkSession.createDataFrame([(-1, -1, f"p sp {graph.vertices.count()} {graph.edges.count()}")], "src bigint, dst bigint, line string")
    _in_order(head.union(graph.edges.select("src", "dst", arc.alias("line"))), ["src", "dst"], path)


def write_coordinates(graph: Graph, path: str) -> None:
    """``n m``, then ``from to value`` lines, 0-based."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("src", "dst", "w")))
    head = graph.vertices.sparkSession.createDataFrame([(-1, -1, f"{graph.vertices.count()} {graph.edges.count()}")], "src bigint, dst bigint, line string")
    _in_order(head.union(graph.edges.select("src", "dst", line.alias("line"))), ["src", "dst"], path)


def store_matrix(matrix: DataFrame, path: str) -> None:
    """The binary form of a matrix: Parquet sorted by row and col inside each range."""
    matrix.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def load_matrix(spark, path: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(path)


def snap_edges(matrix: DataFrame, symmetry: str = "general", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((src, dst), (src, dst, w)): edges without weights, doubled for symmetric, skew and
    hermitian matrices, and the stored edges with seeded random weights from 0 to 100."""
    e = matrix.select(F.col("row").alias("src"), F.col("col").alias("dst"))
    doubled = e.union(e.select("dst", "src")) if symmetry.lower().startswith(("symmetric", "skew", "hermitian")) else e
    # The weight follows from the edge and the seed, so it does not change when a task runs again.
    return doubled, e.withColumn("w", F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(101)))
