"""Scores of predictions as single-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widetab.functions.naming import metrics_for
from widetab.operators.ranks import running_totals

SMALLEST_PROBABILITY = 1e-15


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``(rmse, norm_rmse)``; the second is relative to the population deviation of the target."""
    error = F.col(label).cast("double") - F.col(prediction)
    spread = F.stddev_pop(F.col(label).cast("double"))
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"), spread.alias("_sd")).select(
        "rmse", F.try_divide("rmse", F.nullif("_sd", F.lit(0.0))).alias("norm_rmse")
    )


def true_class_probability(label: Column, probability: Column) -> Column:
    """Probability given to the true class, kept away from 0 and 1; an unknown class has none."""
    given = F.coalesce(F.get(probability, label.cast("int")), F.lit(0.0))
    return F.least(F.greatest(given, F.lit(SMALLEST_PROBABILITY)), F.lit(1.0 - SMALLEST_PROBABILITY))


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """One row ``log_loss`` for class ids and an array of class probabilities."""
    return df.agg((-F.avg(F.log(true_class_probability(F.col(label), F.col(probability))))).alias("log_loss"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """One row ``roc_auc``, exact, with ties counted half.

    Equal scores are added up first, so a score shared by many rows is one row afterwards; the number of
    negatives below each score is a prefix sum by score ranges, so the scores are never sorted in one task.
    """
    return _auc_of_counts(score_counts(df, label, score).persist(), rows_per_bucket)


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``(score, pos, neg)``: rows of both classes per distinct score."""
    positive = F.sum((F.col(label) == 1).cast("bigint"))
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(positive.alias("pos"), F.count(F.lit(1)).alias("n"))
    return counts.select("score", "pos", (F.col("n") - F.col("pos")).alias("neg"))


def _auc_of_counts(counts: DataFrame, rows_per_bucket: int) -> DataFrame:
    placed = running_totals(counts, "score", ["neg"], rows_per_bucket)
    below = F.col("neg_before") + F.col("neg") * F.lit(0.5)
    sums = placed.agg(
        F.sum(F.col("pos") * below).alias("wins"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("q"),
    )
    return sums.select(F.try_divide("wins", F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("roc_auc"))


def roc_auc_value(df: DataFrame, label: str = "label", score: str = "score", rows_per_bucket: int = 1_000_000) -> float | None:
    """The same as a number; the counts are given up afterwards."""
    counts = score_counts(df, label, score).persist()
    try:
        return _auc_of_counts(counts, rows_per_bucket).first()[0]
    finally:
        counts.unpersist()


def evaluate(predictions: DataFrame, task_type: str) -> dict[str, float]:
    """The metrics of a task type for a frame with ``label`` and ``prediction`` or ``probability``."""
    if task_type == "regression":
        return {k: v for k, v in rmse(predictions).first().asDict().items() if k in metrics_for(task_type)}
    if task_type == "binary":
        scored = predictions.select("label", F.get("probability", F.lit(1)).alias("score"))
        return {"roc_auc": roc_auc_value(scored)}
    if task_type == "multiclass":
        return {"log_loss": log_loss(predictions).first()[0]}
    raise ValueError(f"no metric for task type {task_type!r}")
