"""Column statistics of a wide table.

All of them start from one row per cell (``posexplode``) and built-in aggregates keyed by the feature
index. Every task first combines its own cells, so the shuffle carries at most one row per feature and
group from each task, whatever the number of rows; the aggregates (Welford updates) merge exactly and
skip NULL. Results have one row per feature and are small.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widetab.functions.rng import normal
from widetab.functions.vectors import array_literal
from widetab.operators.layout import columns_by_type, to_long

LARGEST = sys.float_info.max


# --- whole-table and per-column statistics ------------------------------------------------------


def long_cells(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    """``(column, value)`` for named top-level columns, cast to one type: one plan for any width."""
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(dtype).alias("value"))
    return df.select(F.inline(F.array(*[cell(c) for c in columns])))


def missing_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``missing_cells``: NULL and NaN cells over all columns, added up inside the row first."""
    columns = list(columns) if columns is not None else df.columns
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    cell = lambda c: F.col(f"`{c}`")
    empty = F.array(*[cell(c).isNull() | F.isnan(cell(c)) if c in floats else cell(c).isNull() for c in columns])
    # one flat array: a sum of terms would nest one level per column
    total = F.size(F.filter(empty, lambda flag: flag))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("missing_cells"))


def missing_features(df: DataFrame, features: str = "features") -> DataFrame:
    """The same count for the array layout."""
    empty = F.size(F.filter(F.col(features), lambda v: v.isNull() | F.isnan(v)))
    return df.agg(F.coalesce(F.sum(empty), F.lit(0)).cast("bigint").alias("missing_cells"))


def column_means(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mean)`` of numeric columns without missing cells; 0.0 when all are missing."""
    columns = list(columns) if columns is not None else columns_by_type(df, "number")
    cells = long_cells(df, columns, "double")
    value = F.when(~F.isnan("value"), F.col("value"))
    return cells.groupBy("column").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def column_modes(df: DataFrame, columns: Sequence[str] | None = None, empty: str = "missing") -> DataFrame:
    """``(column, mode, count)`` of string columns: most frequent value, smallest on ties.

    Values are counted in a first aggregate keyed by value. The single-pass ``mode`` keeps every
    distinct value of a column in one buffer, which a free-text column would overflow.
    """
    columns = list(columns) if columns is not None else columns_by_type(df, "string")
    counted = long_cells(df, columns, "string").groupBy("column", "value").agg(F.count("value").alias("n"))
    best = F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("o"), F.col("value").alias("v")))
    top = counted.groupBy("column").agg(best.alias("b"))
    return top.select(
        "column", F.coalesce(F.when(F.col("b.n") > 0, F.col("b.value")), F.lit(empty)).alias("mode"),
        F.col("b.n").alias("count"),
    )


# --- per-feature statistics of the array layout -------------------------------------------------


def feature_moments(df: DataFrame, by: Sequence[str] = (), features: str = "features") -> DataFrame:
    """``(by..., feature_idx, n, mean, var_pop)``: count, mean and population variance."""
    cells = to_long(df, by, features)
    return cells.groupBy(*by, "feature_idx").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var_pop")
    )


def feature_means(df: DataFrame, features: str = "features") -> DataFrame:
    """``(feature_idx, mean)`` skipping missing cells, 0.0 for an all-missing feature."""
    moments = to_long(df, (), features).groupBy("feature_idx").agg(
        F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0)).alias("mean")
    )
    return moments


def standard_scales(df: DataFrame, features: str = "features") -> DataFrame:
    """``(feature_idx, mean, scale)`` with the population deviation; a constant feature has scale 1."""
    deviation = F.sqrt("var_pop")
    return feature_moments(df, (), features).select(
        "feature_idx", "mean", F.when(F.col("var_pop") == 0, 1.0).otherwise(deviation).alias("scale")
    )


def merge_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge finer ``(n, mean, var_pop)`` rows into coarser groups ``by``.

    Squared differences are taken from the merged mean, so large means do not cancel.
    """
    total = Window.partitionBy(*by)
    centre = F.sum(F.col("n") * F.col("mean")).over(total) / F.sum("n").over(total)
    spread = F.col("n") * (F.col("var_pop") + (F.col("mean") - F.col("_c")) * (F.col("mean") - F.col("_c")))
    return (
        moments.filter(F.col("n") > 0)
        .withColumn("_c", centre)
        .groupBy(*by)
        .agg(F.sum("n").alias("n"), F.first("_c").alias("mean"), F.sum(spread).alias("_s"))
        .withColumn("var_pop", F.col("_s") / F.col("n"))
        .drop("_s")
    )


def training_moments(moments: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Per-fold moments to training moments: for every fold all the *other* folds merged.

    The table was scanned once for all folds; this only expands the small statistics.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_part"))
    expanded = moments.withColumnRenamed(fold, "_part").withColumn(fold, F.explode(others))
    keys = [c for c in moments.columns if c not in (fold, "n", "mean", "var_pop")]
    return merge_moments(expanded.drop("_part"), [fold, *keys])


def anova_from_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA F per feature from class moments ``(by..., feature_idx, label, n, mean, var_pop)``."""
    group = [*by, "feature_idx"]
    per_feature = Window.partitionBy(*group)
    centre = F.sum(F.col("n") * F.col("mean")).over(per_feature) / F.sum("n").over(per_feature)
    offset = F.col("mean") - F.col("_c")
    sums = (
        moments.filter(F.col("n") > 0)
        .withColumn("_c", centre)
        .groupBy(*group)
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("classes"),
            F.sum(F.col("n") * offset * offset).alias("between"),
            F.sum(F.col("n") * F.col("var_pop")).alias("within"),
        )
    )
    between = F.col("between") / F.nullif(F.col("classes") - 1, F.lit(0))
    within = F.col("within") / F.nullif(F.col("n") - F.col("classes"), F.lit(0))
    score = F.when(within > 0, F.try_divide(between, within)).when(
        (within == 0) & (between > 0), F.lit(float("inf"))
    )
    return sums.select(*group, score.alias("score"))


def anova_scores(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """``(feature_idx, score)``: ANOVA F of every feature against the classes of ``label``.

    The score is NULL where it is undefined (constant feature, or fewer than two classes).
    """
    classes = df.select(F.col(label).alias("label"), F.col(features).alias("features"))
    return anova_from_moments(feature_moments(classes, ["label"]))


def regression_scores(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """``(feature_idx, score)``: univariate regression F, ``r^2 / (1 - r^2) * (n - 2)``.

    A constant feature or target scores 0 and a perfect one the largest double.
    """
    cells = to_long(df, (label,), features)
    y = F.col(label).cast("double")
    sums = cells.groupBy("feature_idx").agg(
        F.count("value").alias("n"),
        F.covar_pop("value", y).alias("cov"),
        F.var_pop("value").alias("vx"),
        F.var_pop(y).alias("vy"),
    )
    r2 = F.col("cov") * F.col("cov") / (F.col("vx") * F.col("vy"))
    score = (
        F.when((F.col("vx") == 0) | (F.col("vy") == 0), 0.0)
        .when(r2 >= 1.0, LARGEST)
        .otherwise(r2 / (1.0 - r2) * (F.col("n") - 2))
    )
    return sums.select("feature_idx", score.alias("score"))


def univariate_scores(df: DataFrame, task_type: str) -> DataFrame:
    return regression_scores(df) if task_type == "regression" else anova_scores(df)


def lasso_alpha_max(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """One row ``(alpha_max, alpha)``: the smallest penalty that empties the model, and a tenth of it."""
    cells = to_long(df, (label,), features)
    y = F.col(label).cast("double")
    sums = cells.groupBy("feature_idx").agg(
        F.covar_pop("value", y).alias("cov"), F.stddev_pop("value").alias("sd")
    )
    slope = F.abs(F.col("cov") / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return sums.agg(F.max(slope).alias("alpha_max")).withColumn("alpha", F.col("alpha_max") * F.lit(0.1))


def variance_cut(threshold: float) -> float:
    """Variance of a Bernoulli feature that is constant in a share ``threshold`` of the rows."""
    return threshold * (1 - threshold)


def constant_features(moments: DataFrame) -> list[int]:
    """Features without variance; the list is no longer than the table is wide."""
    return sorted(r["feature_idx"] for r in moments.filter(F.col("var_pop") == 0).select("feature_idx").collect())


def break_constant(df: DataFrame, eps: float = 1e-6, seed: int = 0, part: str | None = None) -> DataFrame:
    """Add N(0, eps) noise to features without variance, so that later stages do not drop them.

    With a ``part`` column only the ``train`` rows are looked at and changed.
    """
    train = df if part is None else df.filter(F.col(part) == "train")
    flagged = constant_features(feature_moments(train))
    if not flagged:
        return df
    at = set(flagged)
    mask = array_literal([int(i in at) for i in range(max(flagged) + 1)], "int")
    is_flagged = lambda i: F.get(mask, i) == 1
    noise = lambda i: normal(seed, F.col("row_id"), i) * F.lit(float(eps))
    changed = F.transform("features", lambda v, i: F.when(is_flagged(i), v + noise(i)).otherwise(v))
    if part is not None:
        changed = F.when(F.col(part) == "train", changed).otherwise(F.col("features"))
    return df.withColumn("features", changed)


# --- task type ----------------------------------------------------------------------------------

MULTICLASS_LIMIT = 20


def label_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """One row ``(n_classes, has_missing)``; a missing label counts as a class of its own."""
    missing = F.coalesce(F.max(F.col(label).isNull().cast("int")), F.lit(0))
    return df.agg((F.count_distinct(label) + missing).alias("n_classes"), (missing > 0).alias("has_missing"))


def task_type_column(classes: Column, numeric: bool) -> Column:
    """``binary`` for 2 classes, ``multiclass`` for 3 to 19, ``regression`` beyond for numbers."""
    many = F.lit("regression") if numeric else F.lit(None).cast("string")
    return (
        F.when(classes == 2, "binary")
        .when((classes > 2) & (classes < MULTICLASS_LIMIT), "multiclass")
        .when(classes >= MULTICLASS_LIMIT, many)
    )


def infer_task_type(df: DataFrame, label: str = "label", given: str | None = None) -> str:
    """Task type of a labelled table; an explicit one wins.

    A target with very many values is recognised by a sketch, so its values are not all shuffled.
    """
    if given:
        return given
    numeric = label in columns_by_type(df, "number")
    if df.agg(F.approx_count_distinct(label)).first()[0] > 50 * MULTICLASS_LIMIT:
        classes = 50 * MULTICLASS_LIMIT
    else:
        classes = label_summary(df, label).first()["n_classes"]
    if classes == 2:
        return "binary"
    if 2 < classes < MULTICLASS_LIMIT:
        return "multiclass"
    if classes >= MULTICLASS_LIMIT and numeric:
        return "regression"
    raise ValueError(f"cannot infer a task type from {classes} distinct labels; give task_type")


# --- ranking of features ------------------------------------------------------------------------


def feature_report(scores: DataFrame, k: int | None = None, selected: Column | None = None) -> DataFrame:
    """``(feature_idx, score, rank, selected)``: best score first, ties and NULL by lowest index.

    ``scores`` has one row per feature, so ranking it in one task is bounded by the table width.
    """
    order = Window.orderBy(F.col("score").desc_nulls_last(), F.col("feature_idx").asc())
    ranked = scores.select("feature_idx", "score").withColumn("rank", F.row_number().over(order))
    if selected is None:
        selected = F.col("rank") <= k if k is not None else F.lit(True)
    return ranked.withColumn("selected", selected)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best features; a bounded top-k, no full sort."""
    return scores.orderBy(F.col("score").desc_nulls_last(), F.col("feature_idx").asc()).limit(k)


def at_least_mean(scores: DataFrame) -> DataFrame:
    """Features whose score is at least the mean score, as a report."""
    marked = scores.withColumn("_mean", F.avg("score").over(Window.partitionBy()))
    return feature_report(scores).drop("selected").join(
        marked.select("feature_idx", (F.col("score") >= F.col("_mean")).alias("selected")), "feature_idx"
    )


def mean_over_views(view_scores: DataFrame) -> DataFrame:
    """``(feature_idx, score)``: signed mean of ``(view_id, feature_idx, score)`` over the views."""
    return view_scores.groupBy("feature_idx").agg(F.avg("score").alias("score"))
