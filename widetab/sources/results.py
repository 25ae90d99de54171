"""Result rows and run configurations as files, and scans over folders of them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from widetab.functions import text
from widetab.functions.naming import RESULT_METRICS

CONFIG_SCHEMA = "run_id string, config string"
# A comma outside quotes.
FIELD_SEPARATOR = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


# --- sinks --------------------------------------------------------------------------------------


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Result rows partitioned by data set, model and method, so runs never overwrite each other."""
    writer = results.write.mode(mode).partitionBy("dataset_name", "model", "method")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_config(spark: SparkSession, run_id: str, config: dict, path: str, fold_times: Sequence[float] | None = None) -> None:
    """One JSON row per run; average and total fold time are added when times were recorded."""
    config = dict(config)
    if fold_times is not None:
        config["avg_fold_time"] = round(sum(fold_times) / len(fold_times), 4) if fold_times else None
        config["total_elapsed_time"] = round(sum(fold_times), 4) if fold_times else None
    row = [(run_id, json.dumps(config, default=str))]
    spark.createDataFrame(row, CONFIG_SCHEMA).write.mode("append").json(path)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary has one row per width or method, so it is written as one CSV file."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)


# --- scans --------------------------------------------------------------------------------------


def _unquote(field: Column) -> Column:
    inner = F.regexp_extract(field, r'^\s*"(.*)"\s*$', 1)
    return F.when(inner != "", F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.when(F.trim(field) == '""', "").otherwise(field))


def whole_files(spark: SparkSession, root: str, pattern: str, recursive: bool) -> DataFrame:
    """``(path, value)``: one row per small text file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def scan_rows(spark: SparkSession, root: str, pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """``(path, file, header, fields MAP<STRING,STRING>, malformed)``: every data row of every CSV file below ``root``.

    A row with another number of cells than its header, or below a header with repeated names, has no fields and is
    marked; :func:`malformed_rows` counts them.

    Files may have different headers, which a multi-file CSV read does not support: it takes the first
    header for all. A result file has one row per fold, so it is read as one value and split in place.
    """
    files = whole_files(spark, root, pattern, recursive)
    lines = F.filter(F.split("value", r"\r?\n"), lambda l: F.trim(l) != "")
    table = files.select("path", text.base_name(F.col("path")).alias("file"), lines.alias("lines"))
    header = F.transform(F.split(F.get("lines", F.lit(0)), FIELD_SEPARATOR), lambda f: F.trim(_unquote(f)))
    rows = table.select(
        "path", "file", header.alias("header"), F.explode_outer(F.slice("lines", 2, 2**31 - 1)).alias("line")
    )
    cells = F.transform(F.split("line", FIELD_SEPARATOR, -1), _unquote)
    fits = F.size(cells) == F.size("header")
    fields = F.when(fits, F.map_from_arrays(F.array_distinct("header"), cells))
    safe = F.when(F.size(F.array_distinct("header")) == F.size("header"), fields)
    return rows.select("path", "file", "header", safe.alias("fields"), (F.col("line").isNotNull() & safe.isNull()).alias("malformed"))


def malformed_rows(rows: DataFrame) -> DataFrame:
    """``(path, file, n_rows, n_malformed)`` of scanned rows: files from which rows are left out, and how many."""
    counts = rows.groupBy("path", "file").agg(
        F.count_if(F.col("malformed") | F.col("fields").isNotNull()).alias("n_rows"), F.count_if("malformed").alias("n_malformed")
    )
    return counts.filter(F.col("n_malformed") > 0)


def load_results(spark: SparkSession, root: str, requested_columns: Sequence[str] = ()) -> DataFrame:
    """Result rows of all files below ``root`` with the metric found in their header.

    Columns: ``path, dataset_name, method, model, repeat, fold, <requested>, metric, score, val_score``.
    The metric is the first of log_loss, roc_auc, rmse that a file has; files without one are left out, and so are
    malformed rows.
    """
    rows = scan_rows(spark, root)
    metric = F.coalesce(*[F.when(F.array_contains("header", m), m) for m in RESULT_METRICS])
    marked = rows.withColumn("metric", metric).filter(F.col("metric").isNotNull() & F.col("fields").isNotNull())
    field = lambda name: F.try_element_at("fields", name if isinstance(name, Column) else F.lit(name))
    return marked.select(
        "path", field("dataset_name").alias("dataset_name"), field("method").alias("method"), field("model").alias("model"),
        field("repeat").try_cast("int").alias("repeat"), field("fold").try_cast("int").alias("fold"),
        *[field(c).alias(c) for c in requested_columns],
        "metric", field(F.col("metric")).try_cast("double").alias("score"),
        field(F.concat(F.lit("val_"), F.col("metric"))).try_cast("double").alias("val_score"),
    )


def enclosing_lines(lines: Column) -> Column:
    """For each line of a file the numbers of the lines it is nested in, outermost first.

    A line is nested in the nearest earlier lines with less indentation. Blank lines and comments do not count.
    """
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.length(F.regexp_extract(line, r"^(\s*)", 1)).alias("indent"), line.rlike(r"^\s*[^\s#]").alias("real")))
    level = "array<struct<at:int,indent:int>>"
    start = F.struct(F.array().cast(level).alias("open"), F.array().cast("array<array<int>>").alias("found"))

    def step(state, line):
        outer = F.filter(state["open"], lambda o: o["indent"] < line["indent"])
        own = F.array(F.struct(line["at"].alias("at"), line["indent"].alias("indent")))
        return F.struct(
            F.when(line["real"], F.concat(outer, own)).otherwise(state["open"]).cast(level).alias("open"),
            F.concat(state["found"], F.array(F.transform(outer, lambda o: o["at"]))).alias("found"),
        )

    return F.aggregate(numbered, start, step, lambda state: state["found"])


def read_config_files(spark: SparkSession, root: str, pattern: str = "*_config.yaml", recursive: bool = True) -> DataFrame:
    """``(path, file, line_no, above, key, kind, ..., indent)`` for the ``key: value`` lines of config files."""
    files = whole_files(spark, root, pattern, recursive)
    split = F.split("value", r"\r?\n")
    rows = files.select("path", text.base_name(F.col("path")).alias("file"), split.alias("lines"), enclosing_lines(split).alias("levels"))
    lines = rows.select("path", "file", "levels", F.posexplode("lines").alias("line_no", "value"))
    above = F.get("levels", F.col("line_no")).alias("above")
    return text.parse_key_values(lines.select("path", "file", "line_no", above, "value")).drop("value")


def config_value(configs: DataFrame, key: str) -> DataFrame:
    """``(path, file, value)``: the first occurrence of ``key`` in every file, depth first.

    A mapping's own entry comes before those of its children, whose order is that of the file. That is the order of the
    lists of enclosing lines, where a list comes before its continuations.
    """
    hit = F.min_by("string_value", F.struct("above", "line_no"))
    return configs.filter(F.col("key") == key).groupBy("path", "file").agg(hit.alias("value"))


def run_stem(file: Column) -> Column:
    """File name without ``_results.*`` or ``_config.*``."""
    return F.regexp_replace(file, r"_(results|config)\..*$", "")


def result_widths(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``(file, stem, num_features)`` of result files: from the config with the same stem, else the name.

    ``files`` has ``file``; ``configs`` has ``file`` and ``value`` (text of ``num_features``).
    """
    known = configs.select(run_stem(F.col("file")).alias("stem"), F.when(F.col("value").rlike(r"^\d+$"), F.col("value")).try_cast("int").alias("given"))
    keyed = files.withColumn("stem", run_stem(F.col("file")))
    return keyed.join(known, "stem", "left").withColumn(
        "num_features", F.coalesce("given", text.width_from_name(F.col("file")))
    ).drop("given")


def load_width_study(spark: SparkSession, root: str, pattern: str = "*_results.csv", metric: str = "log_loss") -> tuple[DataFrame, DataFrame]:
    """``(rows, files)`` of a width study.

    ``rows`` is ``(file, num_features, <metric>)`` with valid scores only; ``files`` says for every file
    whether it was used or why it was skipped.
    """
    rows = scan_rows(spark, root, pattern, recursive=False)
    configs = config_value(read_config_files(spark, root, recursive=False), "num_features")
    score = F.try_element_at("fields", F.lit(metric)).try_cast("double")
    scored = rows.withColumn("_score", F.when(~F.isnan(score), score)).withColumn("_has", F.array_contains("header", metric))
    per_file = scored.groupBy("file").agg(F.max("_has").alias("has_metric"), F.count("_score").alias("n_valid"))
    resolved = result_widths(per_file, configs)
    reason = (
        F.when(F.col("num_features").isNull(), "no width")
        .when(~F.coalesce("has_metric", F.lit(False)), "no metric column")
        .when(F.col("n_valid") == 0, "no valid rows")
        .otherwise("used")
    )
    files = resolved.select("file", "num_features", "n_valid", reason.alias("reason"))
    used = files.filter(F.col("reason") == "used").select("file", "num_features")
    valid = scored.filter(F.col("_score").isNotNull()).select("file", F.col("_score").alias(metric))
    return valid.join(used, "file").select("file", "num_features", metric), files


def skip_counts(files: DataFrame) -> DataFrame:
    """Files per outcome."""
    return files.groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def usable_files(rows: DataFrame, file: str, value: str) -> DataFrame:
    """Files with at least one score that is a number: ``(file, n_rows, n_valid)``."""
    number = F.col(value).try_cast("double")
    valid = F.count(F.when(number.isNotNull() & ~F.isnan(number), 1))
    return rows.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), valid.alias("n_valid")).filter(F.col("n_valid") > 0)
