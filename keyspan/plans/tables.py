"""The driver's tables as sparse examples: an order is a row, its line items are its features.

Slot 1 is the part (value quantity / 50), slot 2 the supplier and slot 3 the line number (both binary). A key is the slot
times SPACE plus the id. The label is 1 for finished orders, else -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = 1_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """How many tasks share a join over a table: one for each 8 MB of its files, at least one a core. What a task holds then stays
    the same however large the table is, whereas the session's number of shuffle partitions is fixed."""
    size = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet").agg(F.sum("length")).first()[0]  # told by names alone
    return max(spark.sparkContext.defaultParallelism, -(-(size or 0) // 8_000_000))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("y"))


def entries(spark: SparkSession, sf_dir: str, *slots: int, placed: bool = False) -> DataFrame:
    """(row_id, slot, key, val) of the named slots, all if none is named; one scan. placed: and `at`, the line's place (file, row)."""
    made = {1: ("l_partkey", F.col("l_quantity") / 50), 2: ("l_suppkey", F.lit(1.0)), 3: ("l_linenumber", F.lit(1.0))}
    each = [F.struct(F.lit(s).alias("slot"), (F.lit(s * SPACE) + F.col(made[s][0])).cast("bigint").alias("key"), made[s][1].alias("val")) for s in slots or made]
    at = [F.struct("_metadata.file_path", "_metadata.row_index").alias("at")] if placed else []
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), *at, F.inline(F.array(*each)))


def weight(key: Column) -> Column:
    """A fixed weight for any key, between -0.5 and 0.5."""
    return (key % 101 - 50) / 100


ROWS_SQL = "rows AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM orders)"
_SLOT_SQL = {1: "l_partkey AS key, l_quantity / 50 AS val", 2: "l_suppkey AS key, 1.0::DOUBLE AS val", 3: "l_linenumber AS key, 1.0::DOUBLE AS val"}


def entries_sql(*slots: int) -> str:
    parts = [f"SELECT l_orderkey AS row_id, {s} AS slot, {s * SPACE} + {_SLOT_SQL[s].replace(' AS key', '::BIGINT AS key')} FROM lineitem" for s in slots or (1, 2, 3)]
    return f"entries AS ({' UNION ALL '.join(parts)})"


def weight_sql(key: str = "key") -> str:
    return f"(({key} % 101 - 50) / 100.0::DOUBLE)"
