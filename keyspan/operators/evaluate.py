"""AUC, accuracy and log-loss of scored rows (label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts, of about as many distinct scores each, in which sums run before they are put in order.
PARTS = 64


def _reflected(x: Column, reflect: bool) -> Column:
    return F.greatest(x, 1 - x) if reflect else x


def _area(groups: DataFrame, reflect: bool) -> DataFrame:
    """(auc) from (s, pos, neg), one row for each distinct score.

    Scores are dealt to ranges by quantiles of the scores that occur, so one far off does no harm; within a range the sums run in a window of its own, and starts of ranges come from at most
    PARTS rows. Ties count half. With one class only there is no area: null.
    """
    cuts = groups.agg(F.array_distinct(F.percentile_approx("s", [k / PARTS for k in range(1, PARTS)], 10_000)).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: F.col("s") >= c))
    dealt = groups.join(F.broadcast(cuts), F.lit(True)).select("s", "pos", "neg", part.alias("part"))  # one row is broadcast
    sizes = dealt.groupBy("part").agg(F.sum("pos").alias("p"))
    before = F.sum("p").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")))
    lower = F.coalesce(F.sum("pos").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.join(starts, "part").select("pos", "neg", (F.col("start") + lower).alias("below"))
    total = ranked.agg(F.sum(F.col("neg") * (F.col("below") + F.col("pos") * 0.5)).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    area = 1 - F.try_divide(F.col("a"), F.col("p") * F.col("n").cast("double"))
    return total.select(_reflected(area, reflect).alias("auc"))


def auc(scored: DataFrame, label: str = "label", score: str = "score", reflect: bool = True) -> DataFrame:
    """(auc): the share of pairs in which the positive scores higher; reflect gives the larger of it and its complement."""
    positive = F.col(label) > 0
    return _area(scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")), reflect)


def buckets(scored: DataFrame, goodness: int = 1000, label: str = "label", score: str = "score") -> DataFrame:
    """(bucket, pos, neg): counts of scores cut to 1/goodness towards zero. Parts of the data merge by adding them up."""
    positive = F.col(label) > 0
    cut = (F.col(score).cast("double") * goodness).cast("bigint")
    return scored.groupBy(cut.alias("bucket")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def auc_bucketed(counts: DataFrame, reflect: bool = True) -> DataFrame:
    return _area(counts.select(F.col("bucket").cast("double").alias("s"), "pos", "neg"), reflect)


def accuracy_bucketed(counts: DataFrame, threshold: float = 0.0, goodness: int = 1000) -> DataFrame:
    """(accuracy): positives at or above the threshold and negatives below it."""
    up = F.col("bucket") >= threshold * goodness
    good = F.sum(F.when(up, F.col("pos")).otherwise(F.col("neg")))
    return counts.agg(F.try_divide(good, F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"))


def accuracy(label: Column, score: Column, threshold: float = 0.0, reflect: bool = True) -> Column:
    """An aggregate; a label of 0 is always wrong."""
    right = ((label > 0) & (score > threshold)) | ((label < 0) & (score <= threshold))
    return _reflected(F.avg(F.when(right, F.lit(1.0)).otherwise(F.lit(0.0))), reflect)


def log_loss(label: Column, score: Column) -> Column:
    """An aggregate: the mean of log(1 + exp(-y s)), y being the sign of the label."""
    z = F.when(label > 0, -score).otherwise(score)
    return F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def evaluate(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(n, auc, accuracy, logloss): one row."""
    y, s = F.col(label), F.col(score)
    rest = scored.agg(F.count("*").alias("n"), accuracy(y, s).alias("accuracy"), log_loss(y, s).alias("logloss"))
    return rest.join(F.broadcast(auc(scored, label, score)), F.lit(True)).select("n", "auc", "accuracy", "logloss")  # one row each
