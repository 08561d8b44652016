"""Shared keyed state: tables of (channel, key, value) with push and pull.

A store is a value: push returns a new one. Where the state is large and lives on, it is written between steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KeyRange, range_index
from ..functions.merge import MERGE

#: Values of one key that a row may hold.
MOST_FOLDED = 1_000_000
#: Layers of fewer elements than this go to one part as a whole.
WHOLE_LAYER = 1000


@dataclass(frozen=True)
class VectorStore:
    """Unique (channel, key) with k values each, as array<double>."""

    table: DataFrame
    k: int = 1

    def _zeros(self) -> Column:
        return F.array_repeat(F.lit(0.0), self.k)

    def push(self, update: DataFrame, op: str = "plus") -> VectorStore:
        """Values of known keys change by `op`; unknown keys are ignored (see unmatched())."""
        new = update.select("channel", "key", F.col("value").alias("_new"))
        merged = F.zip_with("value", "_new", MERGE[op].apply)
        return replace(self, table=self.table.join(new, ["channel", "key"], "left").select("channel", "key", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("value")).alias("value")))

    def unmatched(self, update: DataFrame) -> DataFrame:
        """What a strict push would refuse: pushed keys that the store doesn't know."""
        return update.join(self.table, ["channel", "key"], "left_anti")

    def push_keys(self, keys: DataFrame) -> VectorStore:
        """The union of old and new keys, all values cleared."""
        return replace(self, table=self.table.select("channel", "key").union(keys.select("channel", "key")).distinct().withColumn("value", self._zeros()))

    def push_buffered(self, batches: DataFrame) -> DataFrame:
        """(ts, channel, key, values..., n_senders): per request time the sums over senders of each value column of `batches`
        (ts, sender, channel, key, v0, v1, ...), for keys that the store knows. The shuffle is the barrier."""
        columns = [c for c in batches.columns if c not in ("ts", "sender", "channel", "key")]
        sums = batches.groupBy("ts", "channel", "key").agg(*[F.sum(c).alias(c) for c in columns], F.count_distinct("sender").alias("n_senders"))
        return sums.join(self.table.select("channel", "key"), ["channel", "key"], "left_semi")

    def pull(self, request: DataFrame) -> DataFrame:
        """Every row of `request` (channel, key, ...) with value, zeros where the store has none."""
        return request.join(self.table, ["channel", "key"], "left").withColumn("value", F.coalesce("value", self._zeros()))

    def slices(self, ranges: list[KeyRange]) -> DataFrame:
        """The table with `part`, the range that holds each key."""
        return self.table.withColumn("part", range_index(F.col("key"), ranges))


@dataclass(frozen=True)
class MapStore:
    """key to a state struct that `step` folds values into, in order of arrival."""

    start: Column
    step: Callable[[Column, Column], Column]
    kind: str

    def fold(self, pushes: DataFrame, value: str, order: list[str], state: DataFrame | None = None) -> DataFrame:
        """(key, state) after all pushes (key, value, order columns), from `state` (key, state) if given. Each key's values
        come together in one row; fold_all() bounds how many."""
        ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
        seen = pushes.groupBy("key").agg(ordered.alias("_e"))
        if state is None:
            return seen.select("key", F.aggregate("_e", self.start.cast(self.kind), lambda s, e: self.step(s, e["_v"])).alias("state"))
        joined = state.join(seen, "key", "full")
        begin = F.coalesce(F.col("state"), self.start.cast(self.kind))
        return joined.select("key", F.when(F.col("_e").isNull(), begin).otherwise(F.aggregate("_e", begin, lambda s, e: self.step(s, e["_v"]))).alias("state"))

    def fold_all(self, pushes: DataFrame, value: str, order: list[str], most: int = MOST_FOLDED) -> DataFrame:
        """The same for keys with any number of pushes: a row holds at most `most` values of a key, the state goes from one
        round to the next. A key's pushes are one after another by nature; all keys go on at once."""
        longest = pushes.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if longest <= most:
            return self.fold(pushes, value, order)
        at = F.row_number().over(Window.partitionBy("key").orderBy(*order))
        rounds = pushes.withColumn("_round", F.floor((at - 1) / most)).checkpoint()
        state = None
        for i in range(-(-longest // most)):
            state = self.fold(rounds.where(F.col("_round") == i), value, order, state).checkpoint()
        return state

    def fold_batches(self, batches: list[DataFrame], value: str, order: list[str]) -> DataFrame:
        """The same, batch after batch: a row holds one batch's values of a key."""
        state = None
        for batch in batches:
            state = self.fold(batch, value, order, state)
        if state is None:
            raise ValueError("no batches")
        return state

    def pull(self, keys: DataFrame, state: DataFrame) -> DataFrame:
        """Requested keys with their state; a key asked for the first time starts as new."""
        return keys.join(state, "key", "left").withColumn("state", F.coalesce("state", self.start.cast(self.kind)))


def assign_last(pushes: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(key, val): the default entry, where the last push wins."""
    return pushes.groupBy("key").agg(F.max_by(value, F.struct(*order)).alias("val"))


def sum_all(pushes: DataFrame, value: str) -> DataFrame:
    """(key, val): the summing entry."""
    return pushes.groupBy("key").agg(F.sum(value).alias("val"))


def merge_pushes(pushes: DataFrame, value: str, op: str) -> DataFrame:
    """(key, val) of an operation that doesn't depend on order."""
    gather = MERGE[op].gather
    if gather is None:
        raise ValueError(f"{op} depends on the order of pushes")
    return pushes.groupBy("key").agg(gather(value).alias("val"))


@dataclass(frozen=True)
class LayerStore:
    """(layer, idx, value): tensors of any length."""

    table: DataFrame | None = None

    def push(self, pushes: DataFrame, update: Callable[[Column, Column], Column] | None = None) -> LayerStore:
        """Elements received from all senders are summed and meet the stored ones by `update` (old, received), a sum if None."""
        sums = pushes.groupBy("layer", "idx").agg(F.sum("value").alias("_r"))
        update = update or (lambda old, new: old + new)
        if self.table is None:
            return LayerStore(sums.select("layer", "idx", update(F.lit(0.0), F.col("_r")).alias("value")))
        joined = self.table.join(sums, ["layer", "idx"], "full")
        return LayerStore(joined.select("layer", "idx", update(F.coalesce("value", F.lit(0.0)), F.coalesce("_r", F.lit(0.0))).alias("value")))

    @staticmethod
    def parts(layers: DataFrame, n: int, whole: int = WHOLE_LAYER) -> DataFrame:
        """(layer, part, begin, end) from (layer, size): small layers lie on one part, others are cut evenly."""
        part = F.explode(F.when(F.col("size") < whole, F.array(((F.col("layer") * 991) % n).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(n - 1))))
        cut = lambda i: F.floor(F.col("size") * i / n).cast("bigint")
        small = F.col("size") < whole
        return layers.withColumn("part", part).select("layer", "part", F.when(small, F.lit(0)).otherwise(cut(F.col("part"))).cast("bigint").alias("begin"), F.when(small, F.col("size")).otherwise(cut(F.col("part") + 1)).cast("bigint").alias("end"))
