"""Metrics of classifiers and pair scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotary.operators.ordering import running_sums


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary(rows: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """One row: accuracy, precision, recall, f1 of rows with both values; an empty denominator gives 0."""
    both = rows.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    p, y = F.col(pred) == 1, F.col(label) == 1
    c = both.agg(one(p & y).alias("tp"), one(p & ~y).alias("fp"), one(~p & y).alias("fn"), one(~p & ~y).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def curve(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Of each distinct score taken as threshold: true and false positives, precision, recall, f1, accuracy.

    Rows with equal scores pass together. NaN and null scores are left out."""
    kept = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    by = kept.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) != 1).cast("bigint")).alias("n"))
    run = running_sums(by, [F.col("score").desc()], ["p", "n"])
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    tp, fp, ap, an = F.col("sum_p"), F.col("sum_n"), F.col("all_p"), F.col("all_n")
    return run.crossJoin(F.broadcast(total)).select(  # one row
        "score", tp.alias("tp"), fp.alias("fp"), F.col("p").alias("new_tp"), _share(tp, tp + fp).alias("precision"), _share(tp, ap).alias("recall"),
        _share(2 * tp, tp + fp + ap).alias("f1"), ((tp + an - fp) / (ap + an)).alias("accuracy"), ap.alias("positives"),
    )


def pair_evaluation(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: average precision (the primary metric), best f1 and best accuracy with their thresholds.

    Of thresholds that do equally well the greatest counts."""
    c = curve(rows, score, label)
    return c.agg(
        F.coalesce(F.sum(_share(F.col("precision") * F.col("new_tp"), F.col("positives"))), F.lit(0.0)).alias("average_precision"),
        F.max("f1").alias("best_f1"), F.max(F.struct("f1", "score"))["score"].alias("f1_threshold"),
        F.max("accuracy").alias("best_accuracy"), F.max(F.struct("accuracy", "score"))["score"].alias("accuracy_threshold"),
    )
