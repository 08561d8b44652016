"""Dictionaries of keys and the joins that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import in_range, order_key
from ..functions.merge import MERGE

#: Ranges over which ranks are counted in parallel.
PARTS = 64


def dictionary(keys: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, rank): distinct keys in unsigned order, ranks from 0.

    Keys are sorted in ranges that hold about as many keys each; each range counts its own ranks and starts after the keys of those before it, so no task
    sees them all.
    """
    spread = keys.select("key").distinct().withColumn("_o", order_key(F.col("key")))
    # Quantiles of the keys themselves, so that ranges hold about as many keys each wherever the keys lie.
    cuts = spread.agg(F.percentile_approx("_o", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    part = sum([(F.col("_o") >= F.lit(b)).cast("int") for b in sorted(set(cuts or []))], F.lit(0))
    dealt = spread.withColumn("_p", part)
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("n"))  # at most `parts` rows
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_start")))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
    return dealt.join(starts, "_p").select("key", (F.col("_start") + own - 1).cast("bigint").alias("rank"))


def dealt(df: DataFrame, parts: int | None, by: str) -> DataFrame:
    """Equal values of `by` together, in `parts` tasks."""
    return df.repartition(parts, by) if parts else df


def common_keys(counts: DataFrame, share: int = 1000) -> DataFrame:
    """(key): those of (key, cnt) with more than 1/share of all entries, fewer than `share`."""
    whole = counts.agg((F.sum("cnt") / share).alias("_most"))
    return counts.join(F.broadcast(whole), F.col("cnt") > F.col("_most")).select("key")  # one row is broadcast


def remap(entries: DataFrame, ranks: DataFrame, parts: int | None = None, common: DataFrame | None = None) -> DataFrame:
    """Entries with `idx`, their key's rank; those outside the dictionary are dropped.

    parts: in how many tasks keys meet their ranks; None leaves it to the session. common: at most some thousand keys, each once,
    that are told by broadcast, since all entries of any other key meet in one task.
    """
    ranked = ranks.select("key", F.col("rank").alias("idx"))
    if common is None:
        return dealt(entries, parts, "key").join(dealt(ranked, parts, "key"), "key")
    few = F.broadcast(common.join(ranked, "key").select("key", "idx"))
    rest = entries.join(F.broadcast(common), "key", "left_anti")
    return dealt(rest, parts, "key").join(dealt(ranked, parts, "key"), "key").unionByName(entries.join(few, "key"))


def row_offsets(rows: DataFrame, mapped: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_id, n): entries left of every row, 0 for those that lost all; offsets are running sums of these in any order.

    parts: in how many tasks entries meet their rows; None leaves it to the session.
    """
    left = dealt(mapped.select("row_id"), parts, "row_id").groupBy("row_id").agg(F.count("*").alias("n"))
    return dealt(rows.select("row_id"), parts, "row_id").join(left, "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def ordered_match(src: DataFrame, dst: DataFrame, op: str = "assign") -> DataFrame:
    """(key, val, matched): `dst` with `op` applied where `src` has the key; elsewhere it keeps its value."""
    other = src.select("key", F.col("val").alias("_s"), F.lit(True).alias("_m"))
    met = F.coalesce("_m", F.lit(False))
    return dst.select("key", "val").join(other, "key", "left").select("key", F.when(met, MERGE[op].apply(F.col("val"), F.col("_s"))).otherwise(F.col("val")).alias("val"), met.alias("matched"))


def parallel_union(a: DataFrame, b: DataFrame, op: str = "plus") -> DataFrame:
    """(key, val): all keys of either side, combined by `op` where both have one."""
    x, y = a.select("key", F.col("val").alias("_x")), b.select("key", F.col("val").alias("_y"))
    both = MERGE[op].apply(F.col("_x"), F.col("_y"))
    return x.join(y, "key", "full").select("key", F.when(F.col("_x").isNull(), F.col("_y")).when(F.col("_y").isNull(), F.col("_x")).otherwise(both).alias("val"))


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def key_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def lookup_range(keys: DataFrame, low: int, high: int) -> DataFrame:
    """(begin, end): the places that the keys in [low, high) take among all keys, sorted without sign."""
    below = in_range(F.col("key"), 0, low) if low else F.lit(False)
    return keys.agg(F.count_if(below).alias("begin"), F.count_if(below | in_range(F.col("key"), low, high)).alias("end"))


def score(entries: DataFrame, model: DataFrame, rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_id, score): sums of weight * value, missing weights being 0; rows without entries score 0.

    parts: in how many tasks entries meet their weights, and then their rows; None leaves it to the session. All entries of a
    key meet in one task then.
    """
    met = dealt(entries, parts, "key").join(dealt(model.select("key", "w"), parts, "key"), "key").select("row_id", (F.col("w") * F.col("val")).alias("_x"))
    sums = dealt(met, parts, "row_id").groupBy("row_id").agg(F.sum("_x").alias("score"))
    return dealt(rows.select("row_id"), parts, "row_id").join(sums, "row_id", "left").select("row_id", F.coalesce("score", F.lit(0.0)).alias("score"))


