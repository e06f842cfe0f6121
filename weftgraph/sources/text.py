"""Text lines with their file and number.

The header of a graph file is its first data line, so lines need numbers.  They are counted
in two levels (lines of each input partition, then a prefix sum over partitions), so files
of any size are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, no, line): no rises with the place in each file, and from file to file by name, so
    the ordered parts of a folder are one text; only order is meant, not density.

    Spark numbers rows inside an input partition by ``monotonically_increasing_id``, whose
    upper bits are the partition.  Splits of one file may go to partitions in any order, so
    the split's start offset comes first.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return lines.select("file", F.struct("file", "block", "id").alias("no"), F.col("value").alias("line"))


def first_line(lines: DataFrame) -> str | None:
    """The first line of all."""
    return lines.agg(F.min_by("line", "no").alias("line")).first().line
