"""Labelled tables from CSV, an appended test table, and published tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widetab.operators.layout import with_row_id
from widetab.operators.stats import long_cells

# Texts read as missing. The second line are the usual defaults of CSV readers.
MISSING_TOKENS = (
    "NaN", "nan", "na", "null", "", "?",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "None", "n/a",
)
BOOLEAN_TOKENS = ("true", "false")


def read_text_columns(spark: SparkSession, path: str | Sequence[str], tokens: Sequence[str] = MISSING_TOKENS, **options) -> DataFrame:
    """All columns as STRING with missing tokens as NULL. The built-in option knows one token only."""
    raw = spark.read.csv(path, header=True, inferSchema=False, **options)
    clean = lambda c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c)
    return raw.select(*[clean(c) for c in raw.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type per column from one long-form pass: bigint, double, boolean or string.

    A column without any value is DOUBLE, as readers that use NaN for missing numbers have it.
    """
    value = F.col("value")
    found = (
        long_cells(df, df.columns, "string")
        .filter(value.isNotNull())
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(value.try_cast("bigint")).alias("ints"),
            F.count(value.try_cast("double")).alias("doubles"),
            F.count(F.when(F.lower(value).isin(*BOOLEAN_TOKENS), 1)).alias("flags"),
        )
        .collect()
    )
    types = {c: "double" for c in df.columns}
    for r in found:
        fits = [t for t, k in (("bigint", r["ints"]), ("double", r["doubles"]), ("boolean", r["flags"])) if k == r["n"]]
        types[r["column"]] = fits[0] if fits else "string"
    return types


def read_labelled_csv(
    spark: SparkSession, path: str | Sequence[str], target: str, test_path: str | None = None,
    row_id: str | None = None, tokens: Sequence[str] = MISSING_TOKENS, **options,
) -> DataFrame:
    """``(row_id, label, <features>[, is_test])`` from a CSV with a header.

    Types are inferred over training and test rows together. Without a ``row_id`` column ids are given
    once and checkpointed.
    """
    df = read_text_columns(spark, path, tokens, **options)
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    if test_path:
        df = append_test(df, read_text_columns(spark, test_path, tokens, **options))
    plain = [c for c in df.columns if c != "is_test"]
    types = infer_types(df.select(*plain))
    typed = df.select(
        *[F.col(f"`{c}`").cast(types[c]).alias("label" if c == target else c) for c in plain if c != row_id],
        *([F.col(f"`{row_id}`").cast(types[row_id]).alias("row_id")] if row_id else []),
        *(["is_test"] if test_path else []),
    )
    return typed if row_id else with_row_id(typed)


def append_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union by column name; ``is_test`` remembers the border that a row position would only imply."""
    return train.withColumn("is_test", F.lit(False)).unionByName(
        test.withColumn("is_test", F.lit(True)), allowMissingColumns=True
    )


def split_target(df: DataFrame, target: str, row_id: str) -> tuple[DataFrame, list[str]]:
    """``(row_id, label, features ARRAY<DOUBLE>)`` and the feature names of a numeric table."""
    from widetab.operators.layout import to_array

    names = [c for c in df.columns if c not in (target, row_id)]
    return to_array(df, names, target, row_id), names


def read_task(spark: SparkSession, table_path: str, splits_path: str) -> tuple[DataFrame, DataFrame]:
    """A published task: a parquet table and its split table ``(row_id, repeat, fold, part)``."""
    return spark.read.parquet(table_path), spark.read.parquet(splits_path)


def write_task(table: DataFrame, splits: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Save a task as two tables bucketed by ``row_id``, so that splits join without a shuffle.

    A split table has a row per data row, repeat and fold. Bucketing both sides once pays for itself when
    every unit of an experiment joins them again.
    """
    for df, suffix in ((table, "data"), (splits, "splits")):
        writer = df.write.mode("overwrite").bucketBy(buckets, "row_id").sortBy("row_id").format("parquet")
        if path:
            writer = writer.option("path", f"{path}/{name}_{suffix}")
        writer.saveAsTable(f"{name}_{suffix}")


def read_saved_task(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.table(f"{name}_data"), spark.table(f"{name}_splits")


def split_dimensions(splits: DataFrame) -> tuple[int, int]:
    """Number of repeats and folds of a published split."""
    row = splits.agg(F.max("repeat").alias("r"), F.max("fold").alias("f")).first()
    return int(row["r"]) + 1, int(row["f"]) + 1


def first_tasks(datasets: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(name, dataset_id, task_id)``: for every name its first data set, for that its first task.

    ``datasets`` is ``(dataset_id, name)`` and ``tasks`` is ``(task_id, dataset_id)``. "First" is the
    lowest id, a total order. Both sides are aggregated before they meet.
    """
    named = datasets.groupBy("name").agg(F.min("dataset_id").alias("dataset_id"))
    first = tasks.groupBy("dataset_id").agg(F.min("task_id").alias("task_id"))
    return named.join(first, "dataset_id", "left").select("name", "dataset_id", "task_id")


def find_task(datasets: DataFrame, tasks: DataFrame, wanted: str):
    """Task id for a numeric id or a data set name; an unknown name or one without tasks raises."""
    if str(wanted).isdigit():
        return int(wanted)
    named = datasets.filter(F.col("name") == wanted).orderBy("dataset_id").limit(1).collect()
    if not named:
        raise ValueError(f"no data set is called {wanted!r}")
    found = tasks.filter(F.col("dataset_id") == named[0]["dataset_id"]).orderBy("task_id").limit(1).collect()
    if not found:
        raise ValueError(f"data set {wanted!r} has no task")
    return found[0]["task_id"]
