"""Summaries of result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.functions.naming import display_names


def method_summary(results: DataFrame, metrics: Sequence[str] = ("score",), by: Sequence[str] = ("method",), digits: int = 4) -> DataFrame:
    """Mean and sample deviation of metrics per method, rounded."""
    aggregates = []
    for m in metrics:
        prefix = "" if len(metrics) == 1 else f"{m}_"
        aggregates += [F.round(F.avg(m), digits).alias(f"{prefix}mean"), F.round(F.stddev(m), digits).alias(f"{prefix}std")]
    return results.groupBy(*by).agg(*aggregates)


def width_summary(results: DataFrame, metric: str = "log_loss") -> DataFrame:
    """Mean, deviation (0 for a single row) and rows per target width, sorted by width."""
    valid = results.select("num_features", F.col(metric).try_cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    return (
        valid.groupBy("num_features")
        .agg(
            F.avg("v").alias(f"{metric}_mean"),
            F.coalesce(F.stddev("v"), F.lit(0.0)).alias(f"{metric}_std"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .orderBy("num_features")
    )


def run_summary(results: DataFrame, by: Sequence[str] = ("method",), metric: str = "score", val_metric: str | None = "val_score") -> DataFrame:
    """Test and validation mean and deviation per run, in one aggregate."""
    aggregates = [F.avg(metric).alias("mean"), F.stddev(metric).alias("std")]
    if val_metric and val_metric in results.columns:
        aggregates += [F.avg(val_metric).alias("val_mean"), F.stddev(val_metric).alias("val_std")]
    return results.groupBy(*by).agg(*aggregates)


def model_comparison(results: DataFrame, metric: str = "score", val_metric: str | None = "val_score", names: DataFrame | None = None) -> DataFrame:
    """Runs of all models merged to one row per model and method, with display names on request."""
    summary = run_summary(results, ("model", "method"), metric, val_metric)
    return display_names(summary, "model", names) if names is not None else summary


def comparison_matrix(summary: DataFrame, methods: Sequence[str], value: str = "mean") -> DataFrame:
    """Model x method table of one statistic; the methods are given, so no extra pass looks for them."""
    return summary.groupBy("model").pivot("method", list(methods)).agg(F.first(value))


def fold_times(results: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Average and total fold time, NULL when no time was recorded."""
    return results.groupBy(*by).agg(
        F.round(F.avg("fold_time"), 4).alias("avg_fold_time"),
        F.round(F.sum("fold_time"), 4).alias("total_elapsed_time"),
    )


def numeric_scores(results: DataFrame, column: str) -> DataFrame:
    """Scores read as text become numbers; rows whose score is missing or not a number are dropped."""
    value = F.col(column).try_cast("double")
    return results.withColumn(column, value).filter(F.col(column).isNotNull() & ~F.isnan(column))
