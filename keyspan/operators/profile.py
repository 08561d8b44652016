"""Profiles of feature groups, descriptors of matrices, reductions of arrays, counts of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import format_key, order_key

#: The top of an 8-bit count.
SATURATED = 255


def slot_profile(slots: DataFrame) -> DataFrame:
    """Per slot: format, min_key, max_key (exclusive, decimal), nnz_ele and nnz_ex, from (row_id, slot, keys, vals).

    Partial aggregates merge, so profiles of parts and of the whole agree. The label slot covers [0, 1). Slots without
    elements are left out. A slot is SPARSE if any of its rows has as many values as keys, else SPARSE_BINARY if any has
    keys, else DENSE; mixed says that rows differ.
    """
    n_keys, n_vals = F.size("keys"), F.size("vals")
    kind = F.when((n_keys > 0) & (n_keys == n_vals), F.lit(3)).when(n_keys > 0, F.lit(2)).otherwise(F.lit(1))
    ordered = F.transform("keys", order_key)
    label = F.col("slot") == 0
    rows = slots.select("slot", kind.alias("kind"), F.array_min(ordered).alias("low"), F.array_max(ordered).alias("high"), F.greatest(n_keys, n_vals).cast("bigint").alias("n"))
    found = rows.groupBy("slot").agg(F.max("kind").alias("kind"), F.min("kind").alias("least"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("nnz_ele"), F.count("*").alias("nnz_ex")).where("nnz_ele > 0")
    wide = lambda c: format_key(order_key(F.col(c)))
    whole = lambda n: F.lit(n).cast("decimal(20,0)")
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    return found.select(
        "slot",
        F.get(F.array(F.lit("DENSE"), F.lit("SPARSE_BINARY"), F.lit("SPARSE")), F.col("kind") - 1).alias("format"),
        F.when(label, whole(0)).otherwise(F.coalesce(wide("low"), top)).cast("decimal(20,0)").alias("min_key"),
        F.when(label, whole(1)).otherwise(F.coalesce(wide("high") + 1, whole(0))).cast("decimal(20,0)").alias("max_key"),
        "nnz_ele",
        "nnz_ex",
        (F.col("kind") != F.col("least")).alias("mixed"),
    )


def profile(examples: DataFrame) -> DataFrame:
    """slot_profile() of parsed examples, rows with a slot of 4096 or more left out before anything is counted."""
    good = examples.where(F.forall("slots", lambda s: s["id"] < 4096))
    return slot_profile(good.select("row_id", F.inline("slots")).withColumnRenamed("id", "slot"))


def merge_profiles(*parts: DataFrame) -> DataFrame:
    """Profiles of parts as one of the whole."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.element_at(F.create_map(F.lit("DENSE"), F.lit(1), F.lit("SPARSE_BINARY"), F.lit(2), F.lit("SPARSE"), F.lit(3)), F.col("format"))
    return every.groupBy("slot").agg(F.max_by("format", rank).alias("format"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("nnz_ele").alias("nnz_ele"), F.sum("nnz_ex").alias("nnz_ex"), (F.bool_or("mixed") | (F.count_distinct("format") > 1)).alias("mixed"))


def matrix_info(profiles: DataFrame, n_rows: Column | int) -> DataFrame:
    """Per slot the matrix it makes: type, rows, cols, nnz and nnz per row that has the slot."""
    rows = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    return profiles.select("slot", F.col("format").alias("type"), rows.cast("bigint").alias("n_rows"), (F.col("max_key") - F.col("min_key")).cast("decimal(20,0)").alias("n_cols"), F.col("nnz_ele").alias("nnz"), (F.col("nnz_ele") / F.col("nnz_ex")).alias("nnz_per_row"))


def reductions(value: Column) -> list[Column]:
    """sum, mean, population standard deviation, non-zeros, least and greatest of a column; 0 for the first four of nothing."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.sum(value), zero).alias("total"),
        F.coalesce(F.avg(value), zero).alias("mean"),
        F.coalesce(F.stddev_pop(value), zero).alias("std"),
        F.count_if(value != 0).alias("nnz"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    ]


def key_counts(entries: DataFrame, saturate: int | None = None, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Distinct keys and how often each occurs, capped at `saturate` if given."""
    n = F.count("*")
    return entries.groupBy(*by).agg((n if saturate is None else F.least(n, F.lit(saturate))).cast("bigint").alias("cnt"))
