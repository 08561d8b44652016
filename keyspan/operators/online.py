"""Online training: one superstep per minibatch, over state kept in a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.objective import ADAGRAD_STATE, FTRL_STATE, LOSSES, AdaGrad, Ftrl
from .evaluate import accuracy, auc
from .localize import score
from .store import MapStore

Rule = Ftrl | AdaGrad


def state_kind(rule: Rule) -> str:
    return FTRL_STATE if isinstance(rule, Ftrl) else ADAGRAD_STATE


def gradient(entries: DataFrame, rows: DataFrame, weights: DataFrame, loss: str = "LOGIT") -> DataFrame:
    """(key, g): the sum over the rows (row_id, y) of slope * value at the weights (key, w)."""
    margins = score(entries, weights, rows).withColumnRenamed("score", "m")
    slopes = rows.join(margins, "row_id").select("row_id", LOSSES[loss].slope(F.col("y"), F.col("m")).alias("slope"))
    return entries.join(slopes, "row_id").groupBy("key").agg(F.sum(F.col("slope") * F.col("val")).alias("g"))


def apply_gradient(state: DataFrame | None, grad: DataFrame, rule: Rule) -> DataFrame:
    """(key, state): each key's state after its gradient; keys without one keep theirs."""
    start = rule.start().cast(state_kind(rule))
    if state is None:
        return grad.select("key", rule.step(start, F.col("g")).alias("state"))
    joined = state.join(grad, "key", "full").select("key", F.coalesce("state", start).alias("state"), "g")
    return joined.select("key", F.when(F.col("g").isNull(), F.col("state")).otherwise(rule.step(F.col("state"), F.col("g"))).alias("state"))


def superstep(state: DataFrame | None, entries: DataFrame, rows: DataFrame, rule: Rule, loss: str = "LOGIT") -> DataFrame:
    """State after one minibatch: pull weights, margins, gradients, update."""
    weights = entries.select("key", F.lit(0.0).alias("w")).where("false") if state is None else state.select("key", F.col("state.w").alias("w"))
    return apply_gradient(state, gradient(entries, rows, weights, loss), rule)


def train(batches: Iterable[tuple[DataFrame, DataFrame]], rule: Rule, loss: str = "LOGIT", cut_every: int = 0) -> DataFrame:
    """(key, state) after minibatches (entries, rows) in order, without delay. cut_every checkpoints the state now and then;
    long runs need it, a few batches are one plan."""
    state = None
    for i, (entries, rows) in enumerate(batches, 1):
        state = superstep(state, entries, rows, rule, loss)
        if cut_every and i % cut_every == 0:
            state = state.checkpoint()
    if state is None:
        raise ValueError("no batches")
    return state


def number_rows(rows: DataFrame, order: str = "row_id", by: tuple[str, ...] = (), width: int = 20) -> DataFrame:
    """Rows with `n`, their place from 1 in the order of a whole-number column without repeats, within each group of `by`.

    Numbers may have gaps, as row_id has. Places are counted in spans of 2**width numbers, so no task sorts more than that
    many rows; what is before a span comes from a table with a row for each span.
    """
    spans = rows.withColumn("_p", F.shiftright(F.col(order), width))
    sizes = spans.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_p", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(order))
    return spans.join(starts, [*by, "_p"]).withColumn("n", (F.col("_start") + own).cast("bigint")).select(*rows.columns, "n")


def with_batch(rows: DataFrame, size: int, order: str = "row_id") -> DataFrame:
    """Rows with their minibatch: the first `size` rows in order are batch 0 and so on, whatever gaps `order` has."""
    return number_rows(rows, order).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("bigint")).drop("n")


def weight_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(nnz_change, weight_sum, delta_sum) between two tables (key, w)."""
    both = before.select("key", F.col("w").alias("_b")).join(after.select("key", F.col("w").alias("_a")), "key", "full").select(F.coalesce("_b", F.lit(0.0)).alias("b"), F.coalesce("_a", F.lit(0.0)).alias("a"))
    return both.agg(
        (F.count_if(F.col("a") != 0) - F.count_if(F.col("b") != 0)).alias("nnz_change"),
        F.coalesce(F.sum(F.col("a") * F.col("a")), F.lit(0.0)).alias("weight_sum"),
        F.coalesce(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))), F.lit(0.0)).alias("delta_sum"),
    )


def batch_metrics(scored: DataFrame, loss: str = "LOGIT") -> DataFrame:
    """(batch, n, objective, accuracy) of (batch, y, m)."""
    y, m = F.col("y"), F.col("m")
    return scored.groupBy("batch").agg(F.count("*").alias("n"), F.sum(LOSSES[loss].value(y, m)).alias("objective"), accuracy(y, m).alias("accuracy"))


def merge_progress(progress: DataFrame) -> DataFrame:
    """One row from many (n, objective, auc, accuracy, nnz_change, weight_sum, delta_sum): sums, means, relative change."""
    change: Column = F.try_divide(F.sqrt(F.sum("delta_sum")), F.sqrt(F.sum("weight_sum")))
    return progress.agg(F.sum("n").alias("n"), F.sum("objective").alias("objective"), F.avg("auc").alias("auc"), F.avg("accuracy").alias("accuracy"), F.sum("nnz_change").alias("nnz"), change.alias("relative_change"))


def key_fold(pushes: DataFrame, value: str, order: list[str], rule: Rule) -> DataFrame:
    """(key, state): each key's pushes applied one by one in order, as a server would."""
    return MapStore(rule.start(), rule.step, state_kind(rule)).fold_all(pushes, value, order)


__all__ = ["apply_gradient", "auc", "batch_metrics", "gradient", "key_fold", "merge_progress", "number_rows", "superstep", "train", "weight_change", "with_batch"]
