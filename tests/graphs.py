"""The small graphs that goldens are given for, 0-based."""

from weftgraph.model import Graph

SMALL = (7, "0>1:1 0>2:4 0>3:1 1>4:1 2>1:1 2>4:1 2>5:1 3>5:1 3>6:1 4>6:1 5>6:1")
TRIVIAL = (5, "0>1:1 1>2:1 2>3:1 3>4:1 4>3:1")
MINI = (6, "0>1:2 0>1:5 1>2:1 2>2:1 3>4:7 2>0:1")
INF = 2147483647


def edges(text):
    out = []
    for e in text.split():
        ends, w = e.split(":")
        a, b = ends.split(">")
        out.append((int(a), int(b), int(w)))
    return out


def graph(spark, spec):
    n, text = spec
    return Graph.of(spark.range(n), spark.createDataFrame(edges(text), "src long, dst long, w long"))


def by_id(df, column):
    return [r[column] for r in df.orderBy("id").collect()]
