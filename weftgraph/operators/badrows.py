"""Loading text lines while separating those that cannot be read (problem 4).

Structure (quoting, number of fields) is checked in each line by built-in expressions; lines are
parsed once and written with their fields.  Each distinct spelling of an index or a value is cast
once: that gives a dictionary of spellings with the number they stand for, or the reason why they
stand for none.  The invalid part of the dictionary is joined back to find bad lines, the valid
part to load good ones.  The invalid part is broadcast where its bytes, counted while it was
written, are few.  Else, and for the valid part, which grows with the data, places of spellings
are joined by a shuffle; the dictionary knows how often each spelling occurs, so one that stands
in a third of all lines is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.operators.hot import SHARE, TASK_ROWS, spread_join
from weftgraph.session import Workspace

BLANK = " \t\r"
INDEX_MAX = 2147483647
FIELDS = ("row", "col", "value")


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def parse_lines(lines: DataFrame, line: str = "line", fmt: str = "fmt", kind: str = "kind") -> DataFrame:
    """``lines`` with ``_structure`` (null, ``quoting`` or ``columns``) and ``_f0 .. _f2``, the
    fields as they are spelt, for lines that hold data; null, blank and comment lines are left out.

    fmt ``csv`` separates by single commas, any other by runs of spaces or tabs; kind
    ``pattern`` has two fields, any other three.
    """
    body = _trim(F.col(line))
    data = lines.withColumn("_body", body).filter("_body <> '' AND NOT startswith(_body, '%')")
    b, csv, has = F.col("_body"), F.coalesce(F.col(fmt) == "csv", F.lit(False)), F.col("_quoted")
    # Every quote must belong to a pair around one whole field: count such pairs, and all quotes.
    pairs = F.when(csv, F.regexp_count(b, F.lit(r'(?<=^|,)[ \t\r]*+"[^"]*"[ \t\r]*+(?=,|\z)'))).otherwise(F.regexp_count(b, F.lit(r'(?<![^ \t\r])"[^"]*"(?![^ \t\r])')))
    quotes = F.length(b) - F.length(F.replace(b, F.lit('"'), F.lit("")))
    # Quoted fields may hold separators, so lines with quotes are read field by field, all others split.
    read = F.when(csv, F.regexp_extract_all(F.concat(b, F.lit(",")), F.lit(r'([ \t\r]*+"[^"]*"[ \t\r]*+|[^",]*+),'), F.lit(1)))
    read = read.otherwise(F.regexp_extract_all(b, F.lit(r'"[^"]*"|[^ \t\r"](?:[^ \t"]*[^ \t\r"])?'), F.lit(0)))
    cut = F.when(csv, F.split(b, ",")).otherwise(F.split(b, r"(?<!\r)\r*+[ \t][ \t\r]*+"))
    data = data.withColumn("_quoted", F.contains(b, F.lit('"')))
    data = data.withColumn("_fields", F.when(~has, cut).when(pairs * 2 == quotes, read))
    expected = F.when(F.col(kind) == "pattern", 2).otherwise(3)
    structure = F.when(F.col("_fields").isNull(), "quoting").when(F.size("_fields") != expected, "columns")
    sound = data.withColumn("_structure", structure)
    plain = lambda i: F.replace(_trim(F.get("_fields", F.lit(i))), F.lit('"'), F.lit(""))
    at = [F.when(F.col("_structure").isNull() & (F.lit(i) < expected), F.coalesce(plain(i), F.lit(""))).alias(f"_f{i}") for i in range(3)]
    return sound.select(*[c for c in sound.columns if c not in ("_body", "_quoted", "_fields")], *at)


def index_fault(c: Column) -> Column:
    """Why a spelling is no index, or null: ASCII digits only, from 1 to 2147483647."""
    digits = F.regexp_replace(c, "^0+", "")
    small = (F.length(digits) <= 10) & F.coalesce(digits.try_cast("bigint"), F.lit(0)).between(1, INDEX_MAX)
    return F.when(~c.rlike(r"^[0-9]+\z"), "not a whole number").when(~small, "out of range")


def value_fault(c: Column) -> Column:
    """Why a spelling is no finite number in decimal notation, or null."""
    number = c.try_cast("double")
    finite = F.coalesce(number.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))
    return F.when(~c.rlike(r"^[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"), "not a decimal number").when(~finite, "not finite")


INDEX, VALUE = 0, 1
#: Bytes of invalid spellings and their reasons up to which they are broadcast.
BROADCAST_BYTES = 16 << 20


class _Lines:
    """Parsed lines, written once, and the dictionary of their spellings."""

    def __init__(self, lines: DataFrame, columns: dict[str, str], task_rows: int) -> None:
        self.ws, self.task_rows = Workspace(lines.sparkSession), task_rows
        own = lines.select(*(F.col(f"`{c}`").alias(k) for k, c in columns.items()))
        parsed, n = self.ws.counted(parse_lines(own).drop("line", "fmt", "kind").withColumn("_row", F.monotonically_increasing_id()), "lines")
        self.parsed, self.size, self.keys = parsed, n * 3, ["_row", *(c for c in columns if c not in ("line", "fmt", "kind"))]
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.lit(VALUE if i == 2 else INDEX).alias("kind"), F.col(f"_f{i}").alias("raw")) for i in range(3)))).alias("x")
        self.spelt = parsed.filter("_structure IS NULL").select(*self.keys, each).select(*self.keys, "x.*").filter("raw IS NOT NULL")
        raw, index = F.col("raw"), F.col("kind") == INDEX
        known = self.spelt.groupBy("kind", "raw").agg(F.count("*").alias("n"))
        fault = F.when(index, index_fault(raw)).otherwise(value_fault(raw))
        seen = Observation()
        size = F.sum(F.when(F.col("fault").isNotNull(), F.octet_length("raw") + 64)).alias("bytes")
        cast = known.select("kind", "raw", "n", fault.alias("fault"), F.when(index, raw.try_cast("bigint")).alias("whole"), F.when(~index, raw.try_cast("double")).alias("real"))
        self.known = self.ws.keep(cast.observe(seen, size), "spellings")
        self.invalid_bytes = seen.get["bytes"] or 0

    def invalid(self, broadcast_bytes: int) -> DataFrame:
        """Each place of an invalid spelling with what is wrong with it."""
        known = self.known.filter("fault IS NOT NULL")
        if self.invalid_bytes <= broadcast_bytes:
            return self.spelt.join(F.broadcast(known.drop("n")), ["kind", "raw"])
        return self.joined(known)

    def joined(self, known: DataFrame) -> DataFrame:
        """Each place of a spelling of ``known`` with what the dictionary says of it."""
        hot = known.filter(F.col("n") * SHARE > self.size).select("kind", "raw", F.ceil(F.col("n") * SHARE / F.lit(max(1, self.size))).cast("int").alias("_parts"))
        return spread_join(self.spelt, known.drop("n"), ["kind", "raw"], "_row", self.size, task_rows=self.task_rows, hot=hot)


def bad_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line", fmt: str = "fmt", kind: str = "kind", task_rows: int = TASK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(line_id, reason, fault): one row for each distinct line that cannot be read; reason is the
    first that applies of ``quoting``, ``columns``, ``value``, fault says which fields are wrong.

    Null, blank and comment lines are no data; null fmt and kind count as fields between blanks,
    three of them.  Lines delivered twice come once; an empty table gives no rows.
    """
    t = _Lines(lines, {"line_id": line_id, "line": line, "fmt": fmt, "kind": kind}, task_rows)
    text = F.concat(F.element_at(F.array(*(F.lit(f"{x}: ") for x in FIELDS)), F.col("field") + 1), F.col("fault"))
    wrong = t.invalid(broadcast_bytes).groupBy("_row", "line_id").agg(F.array_sort(F.collect_list(F.struct("field", text.alias("text")))).alias("all"))
    values = wrong.select("line_id", F.lit("value").alias("reason"), F.array_join(F.col("all.text"), "; ").alias("fault"))
    return t.parsed.filter("_structure IS NOT NULL").select("line_id", F.col("_structure").alias("reason"), F.lit(None).cast("string").alias("fault")).union(values).distinct()


def load_lines(lines: DataFrame, line_id: str = "line_id", owner: str = "matrix_id", line: str = "line", fmt: str = "fmt", kind: str = "kind", task_rows: int = TASK_ROWS) -> DataFrame:
    """(line_id, owner, row, col, value): each distinct good line as an element with 0-based
    row and col; value is 1 for kind ``pattern``.  Numbers come from the dictionary of spellings."""
    t = _Lines(lines, {"line_id": line_id, "owner": owner, "line": line, "fmt": fmt, "kind": kind}, task_rows)
    at = lambda i, c: F.max(F.when(F.col("field") == i, F.col(c)))
    each = t.joined(t.known).groupBy(*t.keys).agg((at(0, "whole") - 1).alias("row"), (at(1, "whole") - 1).alias("col"), F.coalesce(at(2, "real"), F.lit(1.0)).alias("value"), F.count("fault").alias("faults"))
    return each.filter("faults = 0").select("line_id", "owner", "row", "col", "value").distinct()
