"""Count-min and Bloom sketches as tables, and the filters built on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bit_probes, probes, sketch_hash
from .profile import SATURATED, key_counts

#: Counters hold at most this.
CAP = 254


def _probed(counts: DataFrame, n: int, k: int) -> DataFrame:
    return counts.withColumn("bucket", F.explode(probes(F.col("key"), n, k)))


def insert(counts: DataFrame, n: int, k: int, cap: int = CAP) -> DataFrame:
    """(bucket, v) from (key, cnt). Capped sums of counts don't depend on order; a key whose probes meet adds twice."""
    return _probed(counts, n, k).groupBy("bucket").agg(F.least(F.sum("cnt"), F.lit(cap)).cast("bigint").alias("v"))


def query(keys: DataFrame, sketch: DataFrame, n: int, k: int, cap: int = CAP) -> DataFrame:
    """(key, est): the least of a key's counters, 0 where one is untouched, never above the cap."""
    found = _probed(keys.select("key"), n, k).join(sketch, "bucket", "left")
    return found.groupBy("key").agg(F.least(F.min(F.coalesce("v", F.lit(0))), F.lit(cap)).cast("bigint").alias("est"))


def tail_filter(entries: DataFrame, freq: int, mode: str = "exact", n: int = 1_000_000, k: int = 2) -> DataFrame:
    """The entries whose key occurs more than `freq` times, exactly or by a sketch of saturated counts. The survivors meet
    the entries in a semi join, which Spark broadcasts where it knows them to be few."""
    if mode == "exact":
        good = key_counts(entries).where(F.col("cnt") > freq)
    else:
        if freq > SATURATED - 1:
            raise ValueError("a sketch of 8-bit counters can't tell frequencies above 254")
        counts = key_counts(entries, SATURATED)
        good = query(counts, insert(counts, n, k), n, k).where(F.col("est") > freq)
    return entries.join(good.select("key"), "key", "left_semi")


def sketch_size(unique_keys: int, ratio: float, workers: int) -> int:
    """Counters for the keys of w workers: w / ln(w + 1) * unique * ratio."""
    w = max(workers, 1)
    return max(64, int(w / math.log(w + 1) * unique_keys * ratio))


def cumulative_filter(batches: DataFrame, freq: int, n: int, k: int, cap: int = CAP) -> DataFrame:
    """(batch, key, est, passes) from (batch, key, cnt): a key passes from the batch on in which its running estimate exceeds
    freq. Counts are added up per bucket and batch first, so the window runs over batches, not over occurrences."""
    per_batch = _probed(batches, n, k).groupBy("bucket", "batch").agg(F.sum("cnt").alias("cnt"))
    so_far = F.sum("cnt").over(Window.partitionBy("bucket").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    running = per_batch.select("bucket", "batch", F.least(so_far, F.lit(cap)).alias("v"))
    return _probed(batches, n, k).join(running, ["bucket", "batch"]).groupBy("batch", "key").agg(F.min("v").cast("bigint").alias("est")).withColumn("passes", F.col("est") > freq)


def bloom_insert(keys: DataFrame, m: int, k: int) -> DataFrame:
    """(bit): the set bits of a Bloom filter of m bits."""
    return keys.select(F.explode(bit_probes(F.col("key"), m, k)).alias("bit")).distinct()


def bloom_query(keys: DataFrame, bits: DataFrame, m: int, k: int) -> DataFrame:
    """(key, member): whether all bits of a key are set."""
    asked = keys.select("key").distinct().withColumn("bit", F.explode(bit_probes(F.col("key"), m, k)))
    return asked.join(bits.withColumn("set", F.lit(True)), "bit", "left").groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("member"))


#: Bits in a block of the blocked filter.
BLOCK_BITS = 512


def blocked_bits(keys: DataFrame, m: int, k: int) -> DataFrame:
    """(key, block, bit) probes of a filter whose bits of one key all lie in one block of 64 bytes."""
    blocks = max(m, 1024) // BLOCK_BITS
    h = sketch_hash(F.col("key"))
    return keys.select("key", (h % blocks).alias("block"), F.explode(bit_probes(F.col("key"), BLOCK_BITS, k)).alias("bit"))


def blocked_query(keys: DataFrame, members: DataFrame, m: int, k: int) -> DataFrame:
    """(key, member) of a blocked Bloom filter over `members`."""
    held = blocked_bits(members, m, k).select("block", "bit").distinct().withColumn("set", F.lit(True))
    return blocked_bits(keys.select("key").distinct(), m, k).join(held, ["block", "bit"], "left").groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("member"))


def bitmap(keys: DataFrame) -> DataFrame:
    """(number, bits, nnz): non-negative keys as bitmaps of 32,768 bits each."""
    at = F.col("key") + 1  # positions count from 1 in Spark's functions
    return keys.groupBy(F.bitmap_bucket_number(at).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).withColumn("nnz", F.bitmap_count("bits"))
