"""Threshold metrics and exact PR/ROC curves from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from towerlens import session
from towerlens.operators import slices
from towerlens.operators.slices import Order

EPSILON = 1e-10


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    actual = F.col(label) == 1
    hit = predicted.cast("int") == 1
    return df.groupBy(*by).agg(
        F.count_if(actual & hit).alias("tp"), F.count_if(~actual & hit).alias("fp"),
        F.count_if(~actual & ~hit).alias("tn"), F.count_if(actual & ~hit).alias("fn"))


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: Column | float = 0.5,
                      by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 (0 where undefined)."""
    edge = threshold if isinstance(threshold, Column) else F.lit(threshold)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion(df, label, F.col(score) >= edge, by).withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def class_report(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes and their averages."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"))

    lines = confusion(df, label, F.col(score) >= threshold).select(
        line("0", tn, fn, fp).alias("zero"), line("1", tp, fp, fn).alias("one"))
    total = F.col("zero.support") + F.col("one.support")

    def average(name: str, weighted: bool) -> Column:
        def mix(field: str) -> Column:
            a, b = F.col(f"zero.{field}"), F.col(f"one.{field}")
            if not weighted:
                return (a + b) / 2
            return _ratio(a * F.col("zero.support") + b * F.col("one.support"), total)
        return F.struct(
            F.lit(name).alias("label"), mix("precision").alias("precision"), mix("recall").alias("recall"),
            mix("f1").alias("f1"), total.alias("support"))

    return lines.select(F.explode(F.array(
        F.col("zero"), F.col("one"), average("macro avg", False), average("weighted avg", True),
    )).alias("_l")).select("_l.*")


def curve_points(df: DataFrame, score: str, label: str, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """One row per distinct score from high to low with cumulative and previous counts.

    Rows are folded to counts per score before any ordering and kept, so that whatever
    produced the scores runs once; the running counts split over tasks when there are many
    distinct scores.
    """
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    ordered = slices.slice_groups(
        session.cut_lineage(counts), by, (Order("score", descending=True),), limit)
    summed = slices.running(ordered, {"tp": F.col("pos"), "fp": F.col("neg")})
    return slices.with_group_total(summed, {"p": F.col("pos"), "n": F.col("neg")}).rows()


def with_rates(points: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate at each point and just above it."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    opening = (before_tp + before_fp) == 0
    return points.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, F.col("p")),
        "fpr": _ratio(fp, F.col("n")),
        "precision_before": F.when(opening, F.lit(1.0)).otherwise(_ratio(before_tp, before_tp + before_fp)),
        "recall_before": _ratio(before_tp, F.col("p")),
        "fpr_before": _ratio(before_fp, F.col("n")),
    })


def areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid PR area, step-wise average precision and ROC area."""
    rated = with_rates(points)
    width = F.col("recall") - F.col("recall_before")
    return rated.groupBy(*by).agg(
        F.sum(width * (F.col("precision") + F.col("precision_before")) / 2).alias("pr_auc"),
        F.sum(width * F.col("precision")).alias("average_precision"),
        F.sum((F.col("fpr") - F.col("fpr_before")) * (F.col("recall") + F.col("recall_before")) / 2).alias("roc_auc"),
    )


def pr_curve(points: DataFrame) -> DataFrame:
    """(recall, precision, threshold) with the closing point (0, 1)."""
    body = with_rates(points).select("recall", "precision", F.col("score").alias("threshold"))
    end = points.sparkSession.range(1).select(
        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"))
    return body.unionByName(end)


def roc_curve(points: DataFrame) -> DataFrame:
    """(fpr, tpr, threshold) with the opening point (0, 0)."""
    body = with_rates(points).select("fpr", F.col("recall").alias("tpr"), F.col("score").alias("threshold"))
    start = points.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return body.unionByName(start)


def best_threshold(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score with the greatest F1; among equals the lowest."""
    rated = with_rates(points)
    precision, recall = F.col("precision"), F.col("recall")
    f1 = 2 * precision * recall / (precision + recall + EPSILON)
    return rated.withColumn("_f1", f1).groupBy(*by).agg(
        F.max_by("score", F.struct("_f1", (-F.col("score")).alias("s"))).alias("threshold"),
        F.max("_f1").alias("f1"))
