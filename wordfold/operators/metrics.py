"""Scores of predictions ``(by, doc_id, label, prediction)``.

Everything is computed from the confusion counts: one aggregation over the predictions,
then work on (classes x classes) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MACRO = ("macroavg_prec", "macroavg_rec", "macroavg_f1")
MICRO = ("microavg_prec", "microavg_rec", "microavg_f1")
METRICS = (*MACRO, *MICRO, "accuracy_score")


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_label(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and false negatives of every true or predicted label."""
    counts = confusion(predictions, by)
    hit = F.col("label") == F.col("prediction")
    cells = F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    return (
        counts.select(*by, F.inline(cells))
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def all_scores(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a column per metric; an undefined ratio counts as 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    s = F.sum
    return per_label(predictions, by).groupBy(*by).agg(
        F.avg(_ratio(tp, tp + fp)).alias("macroavg_prec"),
        F.avg(_ratio(tp, tp + fn)).alias("macroavg_rec"),
        F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("macroavg_f1"),
        _ratio(s(tp), s(tp + fp)).alias("microavg_prec"),
        _ratio(s(tp), s(tp + fn)).alias("microavg_rec"),
        _ratio(2 * s(tp), s(2 * tp + fp + fn)).alias("microavg_f1"),
        _ratio(s(tp), s(tp + fn)).alias("accuracy_score"),
    )


def score(predictions: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    return all_scores(predictions, by).select(*by, F.col(metric).alias("score"))


def macro_precision(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "macroavg_prec", by)


def macro_recall(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "macroavg_rec", by)


def macro_f1(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "macroavg_f1", by)


def micro_precision(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "microavg_prec", by)


def micro_recall(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "microavg_rec", by)


def micro_f1(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "microavg_f1", by)


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score(predictions, "accuracy_score", by)


def multiple_scores(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All seven metrics as rows ``(by, metric, score)``."""
    return all_scores(predictions, by).unpivot(list(by), list(METRICS), "metric", "score")


def scores_per_fold(predictions: DataFrame) -> DataFrame:
    return multiple_scores(predictions, ["classifier", "cv_no"]).select("classifier", "cv_no", "metric", "score")
