"""Method names, metrics and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Methods and their display names.
METHOD_NAMES = {
    "original": "None",
    "random_fs": "Random selection",
    "variance_fs": "Variance threshold",
    "tree_fs": "Tree-based estimators",
    "kbest_fs": "K best selection",
    "pca_dr": "PCA",
    "random_dr": "Gaussian random projection",
    "agglo_dr": "Feature agglomeration",
    "kpca_dr": "Kernel PCA",
    "kbest+pca": "K best selection + PCA",
    "sand_fs": "SAND layer",
    "lasso_fs": "Lasso",
    "tabpfn_fs": "TabPFN-wide+decoder",
}
# Metrics per task type; the first one ranks.
TASK_METRICS = {"regression": ["rmse", "norm_rmse"], "binary": ["roc_auc"], "multiclass": ["log_loss"]}
SMALLER_IS_BETTER = ("rmse", "root_mean_squared_error", "log_loss")
RESULT_METRICS = ("log_loss", "roc_auc", "rmse")


def lookup(key: Column, names: dict[str, str]) -> Column:
    """Name of a key from a small fixed mapping, the key itself when unknown."""
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key


def method_name(method: Column) -> Column:
    return lookup(method, METHOD_NAMES)


def method_category(method: Column) -> Column:
    return (
        F.when(method == "original", "Original")
        .when(method == "kbest+pca", "Feature selection + Dimensionality reduction")
        .when(method.endswith("_fs"), "Feature selection")
        .otherwise("Dimensionality reduction")
    )


def display_names(df: DataFrame, key_col: str, names: DataFrame, out_col: str = "display_name") -> DataFrame:
    """Left join of a ``(key, name)`` table with fall-back to the key.

    No hint: the planner broadcasts the table when its measured size is below the threshold.
    """
    right = names.select(F.col("key").alias("__key"), F.col("name").alias("__name"))
    joined = df.join(right, df[key_col] == right["__key"], "left")
    return joined.withColumn(out_col, F.coalesce("__name", key_col)).drop("__key", "__name")


def metrics_for(task_type: str) -> list[str]:
    if task_type not in TASK_METRICS:
        raise ValueError(f"no metric for task type {task_type!r}")
    return list(TASK_METRICS[task_type])


def metric_for(task_type: Column) -> Column:
    """The ranking metric of a task type, NULL for an unknown one."""
    expr = F.lit(None).cast("string")
    for task, metrics in TASK_METRICS.items():
        expr = F.when(task_type == task, metrics[0]).otherwise(expr)
    return expr


def learner_metric(metric: Column) -> Column:
    return F.when(metric == "rmse", "root_mean_squared_error").otherwise(metric)


def positive_score(metric: Column, score: Column) -> Column:
    """Undo the sign of scorers that always maximise."""
    return F.when(metric.isin(*SMALLER_IS_BETTER), -score).otherwise(score)


def task_type_from_text(text: Column, classes: Column) -> Column:
    """Task type from a published description and its number of classes."""
    lowered = F.lower(text)
    return (
        F.when(lowered.contains("regression"), "regression")
        .when(lowered.contains("classification") & (classes > 2), "multiclass")
        .when(lowered.contains("classification"), "binary")
    )


def split_budget(num_features: int, fs_ratio: float = 0.75) -> tuple[int, int]:
    """Selected and projected columns of the combined method (rounds half to even)."""
    selected = round(fs_ratio * num_features)
    return selected, num_features - selected


def split_budget_columns(num_features: Column, fs_ratio: float = 0.75) -> tuple[Column, Column]:
    selected = F.bround(num_features.cast("double") * F.lit(fs_ratio), 0).cast("int")
    return selected, num_features.cast("int") - selected
