"""Accuracy and agreement metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = 255


def confusion(df: DataFrame, truth: str, predicted: str, n: int, *by: str) -> DataFrame:
    """Counts of every (truth, prediction) pair of ``n`` classes, zeros included; the ignore label and NULLs are left out."""
    counted = df.where((F.col(truth) != IGNORED) & F.col(predicted).isNotNull()).groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(t).alias(truth), F.lit(p).alias(predicted)) for t in range(n) for p in range(n)])
    groups = counted.select(*by).distinct() if by else counted.sparkSession.range(1).select()
    cells = groups.select(*by, F.explode(every).alias("c")).select(*by, "c.*")
    return cells.join(counted, [*by, truth, predicted], "left").select(*by, truth, predicted, F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame, truth: str, predicted: str, classes: list[str], *by: str) -> DataFrame:
    """IoU and F1 of every class, and IoU of all but the first class together; denominators are 1 at least."""

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.greatest(bottom, F.lit(1))

    out = []
    for c, name in enumerate(classes):
        t, p = F.col(truth) == c, F.col(predicted) == c
        tp, fp, fn = total(t & p), total(~t & p), total(t & ~p)
        out += [ratio(tp, tp + fp + fn).alias(f"{name}_iou"), ratio(2 * tp, 2 * tp + fp + fn).alias(f"{name}_f1")]
    t, p = F.col(truth) > 0, F.col(predicted) > 0
    both = total(t & p)
    return matrix.groupBy(*by).agg(*out, ratio(both, both + total(~t & p) + total(t & ~p)).alias("any_iou"))


def binary_scores(df: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """Precision, recall, F1 and IoU; counts are 1 at least below the line, precision + recall 1e-9."""
    tp, fp, fn = (F.count_if(c).cast("double") for c in (truth & predicted, ~truth & predicted, truth & ~predicted))
    sums = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1.0))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1.0))
    iou = F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1.0))
    return sums.select(*by, p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"), iou.alias("iou"))


def roc_auc(df: DataFrame, feature: str, truth: Column) -> DataFrame:
    """Area under the curve by rank sums, ties at their mean rank.

    Ranks come from counts per distinct value, not from a sort of all rows in one task: the cumulative sum
    goes over the distinct values by ranges.
    """
    by_value = df.where(F.col(feature).isNotNull()).groupBy(feature).agg(F.count("*").alias("n"), F.count_if(truth).alias("pos"))
    below = running_total(by_value, feature, "n")
    sums = below.agg(
        F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").cast("double").alias("pos"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("neg")
    )
    area = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return sums.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).alias("auc"))


def running_total(df: DataFrame, order: str, amount: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over all lower ``order``. Two levels: value ranges, then rows inside a range."""
    low, high = F.min(order).alias("low"), F.max(order).alias("high")
    bounds = df.agg(low, high)
    share = F.try_divide((F.col(order) - F.col("low")) * buckets, F.col("high") - F.col("low"))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.coalesce(F.least(F.floor(share), F.lit(buckets - 1)), F.lit(0))).drop("low", "high")
    totals = placed.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    # At most ``buckets`` rows.
    bases = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(bases), "_range").withColumn("before", F.col("_base") + inside).drop("_range", "_base")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of status pairs, with the share of rows that agree."""
    counted = df.groupBy(a, b).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    return counted.crossJoin(F.broadcast(total)).select(a, b, "n", (F.col("same") / F.col("total")).alias("agreement"))
