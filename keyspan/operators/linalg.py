"""Sparse matrices as (row, col, val): products, transposes and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def times(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(row, y): A x for a vector (col, x). Rows that meet no element of x are left out: they are 0."""
    return matrix.join(x.select("col", "x"), "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def trans_times(matrix: DataFrame, y: DataFrame) -> DataFrame:
    """(col, x): A' y for a vector (row, y)."""
    return matrix.join(y.select("row", "y"), "row").groupBy("col").agg(F.sum(F.col("val") * F.col("y")).alias("x"))


def dot_times(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, val): the product of elements at the same places."""
    return a.join(b.select("row", "col", F.col("val").alias("_b")), ["row", "col"]).select("row", "col", (F.col("val") * F.col("_b")).alias("val"))


def column_major(matrix: DataFrame, partitions: int | None = None) -> DataFrame:
    """Columns together and each sorted by row."""
    dealt = matrix.repartition(partitions, "col") if partitions else matrix.repartition("col")
    return dealt.sortWithinPartitions("col", "row")


def row_major(matrix: DataFrame, partitions: int | None = None) -> DataFrame:
    dealt = matrix.repartition(partitions, "row") if partitions else matrix.repartition("row")
    return dealt.sortWithinPartitions("row", "col")


def compressed(matrix: DataFrame, major: str, minor: str) -> DataFrame:
    """(major, indices, values): one row for each row or column, elements in order."""
    pairs = F.array_sort(F.collect_list(F.struct(minor, "val")))
    return matrix.groupBy(major).agg(pairs.alias("e")).select(major, F.transform("e", lambda e: e[minor]).alias("indices"), F.transform("e", lambda e: e["val"]).alias("vals"))


def row_block(matrix: DataFrame, begin: int, end: int) -> DataFrame:
    return matrix.where((F.col("row") >= begin) & (F.col("row") < end))


def col_block(matrix: DataFrame, begin: int, end: int) -> DataFrame:
    return matrix.where((F.col("col") >= begin) & (F.col("col") < end))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def segment(a: Column, begin: int, end: int) -> Column:
    return F.slice(a, begin + 1, max(0, end - begin))


def resize(a: Column, n: int, fill: Column) -> Column:
    """Cut or filled up to n elements."""
    return F.slice(F.concat(a, F.array_repeat(fill, n)), 1, n)


def initial(kind: str, constant: float = 1.0, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Column:
    """Start values: ZERO, CONSTANT or GAUSSIAN."""
    if kind == "ZERO":
        return F.lit(0.0)
    if kind == "CONSTANT":
        return F.lit(float(constant))
    if kind == "GAUSSIAN":
        return F.randn(seed) * std + mean
    raise ValueError(f"no start values {kind}")
