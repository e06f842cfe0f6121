"""Queries of the operators for skewed, dangling and broken rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.badrows import bad_lines, load_lines
from weftgraph.operators.orphans import dangling_references, dangling_report
from weftgraph.operators.skew import heavy_keys, keyed_percentiles, keyed_stats, segment_counts
from weftgraph.session import table

P2_SHARE = "0.01"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "matrix_element"), "row", "value", P2_SHARE).select(F.col("key").alias("row"))


def p2_row_stats(spark: SparkSession, d: str) -> DataFrame:
    s = keyed_stats(table(spark, d, "matrix_element"), "row", "value")
    return s.select(F.col("key").alias("row"), "n", "n_value", F.round("value_sum", 3).alias("value_sum"), "n_distinct", "mode", "mode_n")


def p2_row_medians(spark: SparkSession, d: str) -> DataFrame:
    s = keyed_percentiles(table(spark, d, "matrix_element"), "row", "value", ["0.5", "0.9"])
    return s.select(F.col("key").alias("row"), F.col("p0").alias("median"), F.col("p1").alias("p90"))


def p2_csr_rows(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each row id over all matrices, from the row offsets."""
    s = segment_counts(table(spark, d, "matrix_csr"), "matrix_id", "seg", "csr")
    return s.groupBy(F.col("seg").alias("row")).agg(F.sum("n").alias("n"))


def _dangling(spark: SparkSession, d: str, **options: int) -> DataFrame:
    return dangling_references(
        table(spark, d, "matrix_element"), table(spark, d, "sparse_matrix"), "element_id", "matrix_id", "loaded_at",
        {"row": "height", "col": "width"}, "matrix_id", "valid_from", "valid_to", **options,
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select(F.col("id").alias("element_id"), F.col("field").alias("ref_field"), "reason")


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """p3_found by the way for parents of any number: references move to salted ranges."""
    return _dangling(spark, d, broadcast_bytes=-1, range_rows=16, rows_per_salt=50_000).select(F.col("id").alias("element_id"), F.col("field").alias("ref_field"), "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    r = dangling_report(_dangling(spark, d))
    return r.select(F.col("field").alias("ref_field"), F.date_format("month", "yyyy-MM").alias("month"), "reason", "n")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_lines(table(spark, d, "matrix_line")).select("line_id", "reason")


def p4_spread(spark: SparkSession, d: str) -> DataFrame:
    """p4_found by the way for any number of invalid spellings, hot ones spread."""
    return bad_lines(table(spark, d, "matrix_line"), task_rows=0, broadcast_bytes=-1).select("line_id", "reason")


def p4_elements(spark: SparkSession, d: str) -> DataFrame:
    e = load_lines(table(spark, d, "matrix_line"))
    return e.select("line_id", F.col("owner").alias("matrix_id"), "row", "col", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (p2_found, p2_row_stats, p2_row_medians, p2_csr_rows, p3_found, p3_ranges, p3_report, p4_found, p4_spread, p4_elements)}

_DANGLING = """
WITH m AS (SELECT DISTINCT matrix_id, height, width, valid_from, valid_to FROM sparse_matrix WHERE matrix_id IS NOT NULL),
e AS (SELECT DISTINCT element_id, matrix_id, loaded_at, row AS r, col AS c FROM matrix_element),
refs AS (
    SELECT element_id, matrix_id, loaded_at, 'row' AS ref_field, r AS x FROM e WHERE r IS NOT NULL
    UNION ALL SELECT element_id, matrix_id, loaded_at, 'col', c FROM e WHERE c IS NOT NULL),
j AS (
    SELECT refs.*, m.valid_from, m.valid_to, x >= 0 AND x < CASE ref_field WHEN 'row' THEN height ELSE width END AS has
    FROM refs LEFT JOIN m USING (matrix_id)),
s AS (
    SELECT element_id, ref_field, loaded_at, x,
        bool_or(coalesce(has AND valid_from <= loaded_at AND (valid_to IS NULL OR valid_to > loaded_at), false)) AS holds,
        bool_or(coalesce(has AND valid_from > loaded_at, false)) AS late,
        bool_or(coalesce(has AND valid_to <= loaded_at, false)) AS gone
    FROM j GROUP BY element_id, ref_field, loaded_at, x, matrix_id),
found AS (
    SELECT DISTINCT element_id, ref_field, loaded_at, CASE WHEN late THEN 'late' WHEN gone THEN 'deleted' ELSE 'missing' END AS reason
    FROM s WHERE NOT holds)
"""

_LINES = r"""
WITH b AS (
    SELECT DISTINCT line_id, matrix_id, fmt = 'csv' AS csv, kind = 'pattern' AS pattern, trim(line, e' \t\r') AS body
    FROM matrix_line WHERE line IS NOT NULL AND trim(line, e' \t\r') <> '' AND trim(line, e' \t\r') NOT LIKE '\%%' ESCAPE '\'),
q AS (
    SELECT *, CASE
        WHEN csv THEN regexp_full_match(body, '([ \t\r]*"[^"]*"[ \t\r]*|[^",]*)(,([ \t\r]*"[^"]*"[ \t\r]*|[^",]*))*')
        ELSE regexp_full_match(body, '("[^"]*"|[^ \t"]+)([ \t\r]*[ \t][ \t\r]*("[^"]*"|[^ \t"]+))*') END AS well
    FROM b),
f AS (
    SELECT *, list_transform(
        CASE WHEN csv THEN regexp_extract_all(body || ',', '([ \t\r]*"[^"]*"[ \t\r]*|[^",]*),', 1)
        ELSE regexp_extract_all(body, '"[^"]*"|[^ \t\r"]+') END, lambda x: replace(trim(x, e' \t\r'), '"', '')) AS fields
    FROM q),
v AS (
    SELECT *, len(fields) = CASE WHEN pattern THEN 2 ELSE 3 END AS complete,
        coalesce(regexp_full_match(fields[1], '[0-9]+') AND try_cast(fields[1] AS DOUBLE) BETWEEN 1 AND 2147483647
            AND regexp_full_match(fields[2], '[0-9]+') AND try_cast(fields[2] AS DOUBLE) BETWEEN 1 AND 2147483647, false)
        AND (pattern OR coalesce(regexp_full_match(fields[3], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(fields[3] AS DOUBLE)), false)) AS sound
    FROM f)
"""

_ROWS = "FROM matrix_element WHERE row IS NOT NULL"

ORACLE_SQL = {
    "p2_found": f"SELECT row {_ROWS} GROUP BY row HAVING count(*) * 100 >= (SELECT count(*) {_ROWS})",
    "p2_row_stats": f"""
        WITH f AS (SELECT row, value, count(*) AS w {_ROWS} GROUP BY row, value),
        r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY (value IS NULL), w DESC, value) AS k FROM f)
        SELECT row, CAST(sum(w) AS BIGINT) AS n, CAST(coalesce(sum(w) FILTER (value IS NOT NULL), 0) AS BIGINT) AS n_value,
            round(sum(value * w), 3) AS value_sum, count(value) AS n_distinct,
            max(value) FILTER (k = 1) AS mode, max(w) FILTER (k = 1 AND value IS NOT NULL) AS mode_n
        FROM r GROUP BY row""",
    "p2_row_medians": f"""
        SELECT row, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90 {_ROWS} AND value IS NOT NULL GROUP BY row""",
    "p2_csr_rows": """
        WITH o AS (SELECT DISTINCT matrix_id, seg, csr FROM matrix_csr)
        SELECT a.seg AS row, CAST(sum(b.csr - a.csr) AS BIGINT) AS n FROM o a JOIN o b ON a.matrix_id = b.matrix_id AND b.seg = a.seg + 1 GROUP BY a.seg""",
    "p3_found": f"{_DANGLING} SELECT DISTINCT element_id, ref_field, reason FROM found",
    "p3_ranges": f"{_DANGLING} SELECT DISTINCT element_id, ref_field, reason FROM found",
    "p3_report": f"{_DANGLING} SELECT ref_field, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS n FROM found GROUP BY ALL",
    "p4_found": f"""{_LINES}
        SELECT DISTINCT line_id, CASE WHEN NOT well THEN 'quoting' WHEN NOT complete THEN 'columns' ELSE 'value' END AS reason
        FROM v WHERE NOT (well AND complete AND sound)""",
    "p4_elements": f"""{_LINES}
        SELECT DISTINCT line_id, matrix_id, CAST(fields[1] AS BIGINT) - 1 AS row, CAST(fields[2] AS BIGINT) - 1 AS col,
            CASE WHEN pattern THEN 1.0::DOUBLE ELSE round(CAST(fields[3] AS DOUBLE), 6) END AS value
        FROM v WHERE well AND complete AND sound""",
}
ORACLE_SQL["p4_spread"] = ORACLE_SQL["p4_found"]
