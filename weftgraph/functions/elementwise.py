"""Element-wise predicates and binary operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPARE = {
    "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b, "equal_to": lambda a, b: a == b, "not_equal_to": lambda a, b: a != b,
}

ARITHMETIC = {
    "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "multiplies": lambda a, b: a * b, "modulus": lambda a, b: a % b,
    "bit_or": Column.bitwiseOR, "bit_and": Column.bitwiseAND, "bit_xor": Column.bitwiseXOR,
    "maximum": F.greatest, "minimum": F.least, "identity": lambda a, b=None: a,
}


def transform(df: DataFrame, a: str, b: str, op: str, to: str = "value") -> DataFrame:
    """``df`` with ``to``: the operation of two of its columns; ANSI mode raises on overflow."""
    return df.withColumn(to, (ARITHMETIC | COMPARE)[op](F.col(a), F.col(b)))


def zip_transform(a: DataFrame, b: DataFrame, op: str, pos: str = "pos", value: str = "val") -> DataFrame:
    """(pos, val): the operation of two arrays, place by place."""
    x, y = a.select(pos, F.col(value).alias("_a")), b.select(pos, F.col(value).alias("_b"))
    return x.join(y, pos).select(pos, (ARITHMETIC | COMPARE)[op](F.col("_a"), F.col("_b")).alias("val"))


def copy(df: DataFrame) -> DataFrame:
    """The array itself: DataFrames are never changed in place, so nothing is moved."""
    return df.select("*")


def constant(spark: SparkSession, n: int, value: object) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("val"))


def counting(spark: SparkSession, n: int, start: int = 0, step: int = 1) -> DataFrame:
    """(pos, val): start, start + step, ..."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * step + start).alias("val"))
