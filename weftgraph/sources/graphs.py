"""Readers of graph files. Vertex ids become 0-based; weights default to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators.order import number_rows
from weftgraph.sources.errors import BadEdge, BadHeader, BadVertex, NoGraph, NotSquare, SpliceMismatch, WrongCount
from weftgraph.sources.text import first_line, numbered_lines

BLANKS = r"[ \t\r]+"


def _fields(c: Column) -> Column:
    return F.split(F.btrim(c, F.lit(" \t\r")), BLANKS)


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id")


def _sizes(line: str | None, n: int, what: str) -> list[int]:
    if line is None:
        raise NoGraph(f"no {what} found")
    try:
        got = [int(x) for x in line.split()]
    except ValueError:
        raise BadHeader(f"cannot read the {what}: {line!r}") from None
    if len(got) < n or min(got, default=0) < 0:
        raise BadHeader(f"the {what} needs {n} numbers: {line!r}")
    return got


def _after_first(lines: DataFrame) -> DataFrame:
    """All lines but the first."""
    head = lines.agg(F.min("no")).first()[0]
    if head is None:
        return lines
    return lines.filter((F.col("no.file") != head["file"]) | (F.col("no.block") != head["block"]) | (F.col("no.id") != head["id"]))


def _checked(edges: DataFrame, n: int, declared: int | None, bad: Column, what: str = "edges") -> None:
    """One pass over the parsed lines for all that can be wrong with them."""
    out = ~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)
    c = edges.agg(F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.max(F.when(bad, F.col("line"))).alias("example"), F.sum(F.when(out, 1).otherwise(0)).alias("out")).first()
    if c.bad:
        raise BadEdge(f"{c.bad} lines cannot be read, such as {c.example!r}")
    if declared is not None and c.n != declared:
        raise WrongCount(f"{declared} {what} declared, {c.n} found")
    if c.out:
        raise BadVertex(f"{c.out} edges name a vertex outside of 0..{n - 1}")


def read_market(spark: SparkSession, path: str, undirected: bool = False, integer: bool = True, check: bool = True) -> Graph:
    """A graph from a Matrix Market file: lines with ``%`` are skipped, the first other line is
    ``rows cols edges``, each further one ``row col [weight]``, 1-based.

    ``integer`` cuts weights to whole numbers.  ``undirected`` adds each edge reversed.  The
    banner's symmetry is not honoured; read_matrix does that.  Raises NoGraph, BadHeader,
    NotSquare, BadEdge, BadVertex or WrongCount; ``check=False`` skips the pass over all lines.
    """
    data = numbered_lines(spark, path).filter(F.btrim("line", F.lit(" \t\r")) != "").filter(~F.ltrim("line").startswith("%"))
    rows, cols, m = _sizes(first_line(data), 3, "size line")[:3]
    if rows != cols:
        raise NotSquare(f"{rows} rows and {cols} columns")
    f = _fields(F.col("line"))
    third = F.get(f, F.lit(2))
    weight = F.coalesce(third.try_cast("double"), F.lit(1.0))
    body = _after_first(data).select(
        "line", (F.get(f, F.lit(0)).try_cast("bigint") - 1).alias("src"), (F.get(f, F.lit(1)).try_cast("bigint") - 1).alias("dst"),
        (weight.cast("bigint") if integer else weight).alias("w"), (third.isNotNull() & third.try_cast("double").isNull()).alias("odd"),
    )
    if check:
        _checked(body, rows, m, F.col("src").isNull() | F.col("dst").isNull() | F.col("odd"))
    g = Graph.of(_vertices(spark, rows), body.select("src", "dst", "w"))
    return g.both_ways() if undirected else g


def read_dimacs(spark: SparkSession, path: str, splice: int = 0, undirected: bool = False, check: bool = True) -> Graph:
    """A graph from DIMACS files: ``p <type> n m`` and arcs ``a u v w``, 1-based; other lines
    are skipped.  ``splice`` k reads ``path.0`` to ``path.k-1``, which must agree on n."""
    paths = [f"{path}.{k}" for k in range(splice)] if splice else [path]
    lines = numbered_lines(spark, paths)
    f = _fields(F.col("line"))
    heads = [r.line for r in lines.filter(F.get(f, F.lit(0)) == "p").select("line").limit(len(paths) + 1).collect()]
    if not heads:
        raise NoGraph("no problem line found")
    sizes = [_sizes(" ".join(h.split()[2:]), 2, "problem line")[:2] for h in heads]
    if len({n for n, _ in sizes}) > 1:
        raise SpliceMismatch(f"numbers of vertices: {sorted({n for n, _ in sizes})}")
    at = lambda i, t: F.get(f, F.lit(i)).try_cast(t)
    arcs = lines.filter(F.get(f, F.lit(0)) == "a").select("line", (at(1, "bigint") - 1).alias("src"), (at(2, "bigint") - 1).alias("dst"), F.coalesce(at(3, "bigint"), F.lit(1)).alias("w"))
    if check:
        _checked(arcs, sizes[0][0], sum(m for _, m in sizes), F.col("src").isNull() | F.col("dst").isNull(), "arcs")
    g = Graph.of(_vertices(spark, sizes[0][0]), arcs.select("src", "dst", "w"))
    return g.both_ways() if undirected else g


def read_metis(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A graph from a METIS file: header ``n m``, then line i lists the 1-based neighbours of
    vertex i; blank lines are isolated vertices, lines with ``%`` are comments.

    m counts undirected edges, listed from both ends; a file that counts each listed
    neighbour is accepted too.  Weights are not read.
    """
    lines = numbered_lines(spark, path).filter(~F.startswith(F.ltrim("line"), F.lit("%")))
    n, m = _sizes(first_line(lines), 2, "header")[:2]
    placed = number_rows(lines.select("file", F.col("no.block").alias("block"), F.col("no.id").alias("id"), "line"), ["file", "block", "id"], "k").filter("k > 0")
    near = placed.select("line", (F.col("k") - 1).alias("src"), F.explode(F.filter(_fields(F.col("line")), lambda x: x != "")).alias("u"))
    e = near.select("line", "src", (F.col("u").try_cast("bigint") - 1).alias("dst"), F.lit(1).cast("bigint").alias("w"))
    if check:
        _checked(e.filter(F.col("src") < n), n, None, F.col("dst").isNull())
        found, last = e.count(), placed.filter(F.btrim("line", F.lit(" \t\r")) != "").agg(F.max("k")).first()[0] or 0
        if found not in (2 * m, m):
            raise WrongCount(f"{m} edges declared, {found} neighbours found")
        if last > n:
            raise BadVertex(f"{n} vertices declared, {last} lines found")
    return Graph.of(_vertices(spark, n), e.select("src", "dst", "w"))


def read_coordinates(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A graph from a plain file: ``n m``, then ``from to value`` lines, 0-based."""
    lines = numbered_lines(spark, path).filter(F.btrim("line", F.lit(" \t\r")) != "")
    n, m = _sizes(first_line(lines), 2, "header")[:2]
    f = _fields(F.col("line"))
    body = _after_first(lines).select(
        "line", F.get(f, F.lit(0)).try_cast("bigint").alias("src"), F.get(f, F.lit(1)).try_cast("bigint").alias("dst"), F.coalesce(F.get(f, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("w")
    )
    if check:
        _checked(body, n, m, F.col("src").isNull() | F.col("dst").isNull())
    return Graph.of(_vertices(spark, n), body.select("src", "dst", "w"))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((row, col, value), height, width) from a Matrix Market coordinate file, 0-based.

    ``symmetric`` elements off the diagonal are mirrored, ``skew-symmetric`` ones mirrored and
    negated; ``pattern`` values are 1.
    """
    lines = numbered_lines(spark, path)
    banner = (first_line(lines) or "").lower().split()
    if len(banner) < 5 or banner[0] != "%%matrixmarket" or banner[1] != "matrix" or banner[2] != "coordinate":
        raise BadHeader("no banner of a coordinate matrix")
    if banner[3] not in ("real", "pattern", "integer"):
        raise BadHeader(f"field {banner[3]} is not supported")
    data = lines.filter(F.btrim("line", F.lit(" \t\r")) != "").filter(~F.startswith(F.col("line"), F.lit("%")))
    height, width, _ = _sizes(first_line(data), 3, "size line")[:3]
    f = _fields(F.col("line"))
    value = F.lit(1.0) if banner[3] == "pattern" else F.get(f, F.lit(2)).cast("double")
    m = _after_first(data).select((F.get(f, F.lit(0)).cast("bigint") - 1).alias("row"), (F.get(f, F.lit(1)).cast("bigint") - 1).alias("col"), value.alias("value"))
    if banner[4].startswith(("symmetric", "skew")):
        sign = -1.0 if banner[4].startswith("skew") else 1.0
        m = m.union(m.filter("row <> col").select("col", "row", (F.col("value") * sign).alias("value")))
    return m, height, width


def read_sources(spark: SparkSession, path: str, origin: int = 1, most: int = 1000) -> list[int]:
    """Starting vertices, one number a line, of which the first ``most`` count; made 0-based."""
    lines = numbered_lines(spark, path).filter(F.btrim("line", F.lit(" \t\r")) != "").orderBy("no").limit(most).collect()
    return [int(r.line) - origin for r in lines]


def random_sources(graph: Graph, n: int, seed: int) -> list[int]:
    """``n`` vertices with out-edges, drawn with replacement; the seed fixes them."""
    import random

    some = number_rows(graph.edges.select(F.col("src").alias("id")).distinct(), ["id"], "k")
    size = some.count()
    if not size:
        return []
    draws = random.Random(seed).choices(range(size), k=n)
    got = {r.k: r.id for r in some.filter(F.col("k").isin(draws)).collect()}
    return [got[x] for x in draws]
