"""String functions used for run names, configuration lines and result files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of run and file names.
TIME_FORMAT = "yyyyMMdd_HHmmss"
WIDTH_PATTERN = r"num_features[_\- ]+(\d+)"
HYPERPARAM_PATTERN = r"_s(\d+)_nf(\d+)_vt([\d.]+)_nte(\d+)"
KEY_VALUE_PATTERN = r"^\s*([A-Za-z0-9_]+)\s*:\s*(.+?)\s*$"
INT_PATTERN = r"^-?\d+$"
FLOAT_PATTERN = r"^-?\d+\.\d+$"
RESULT_SUFFIX = "_results.csv"
CONFIG_SUFFIX = "_config.yaml"


def slug(text: Column) -> Column:
    """Lower case, every run of other characters than digits and a-z becomes ``_``, ends trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", "_"), F.lit("_"))


def _group(text: Column, pattern: str, group: int, dtype: str) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).try_cast(dtype)


def width_from_name(name: Column) -> Column:
    """``num_features`` written in a file name, NULL when there is none."""
    return _group(name, WIDTH_PATTERN, 1, "int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def hyperparams_from_name(path: Column) -> Column:
    """Struct ``(seed, nf, vt, nte)`` written in a file name; NULL when the pattern is absent."""
    name = base_name(path)
    types = (("seed", "int"), ("nf", "int"), ("vt", "double"), ("nte", "int"))
    fields = [_group(name, HYPERPARAM_PATTERN, i + 1, t).alias(n) for i, (n, t) in enumerate(types)]
    return F.when(name.rlike(HYPERPARAM_PATTERN), F.struct(*fields))


def run_id(dataset: Column, method: Column, num_features: Column, started: Column) -> Column:
    """``<dataset>_<method>_num_features_<k>_<timestamp>``."""
    return F.concat_ws(
        "_", dataset, method, F.lit("num_features"), num_features.cast("string"),
        F.date_format(started, TIME_FORMAT),
    )


def parse_key_values(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per ``key: value`` line with the value typed as int, float, bool or string.

    Adds ``key``, ``kind``, ``int_value``, ``float_value``, ``bool_value`` and ``string_value``
    (the raw text) and ``indent``; other columns are kept and lines of another form are dropped.
    """
    text = F.col(text_col)
    value = F.regexp_extract(text, KEY_VALUE_PATTERN, 2)
    kind = (
        F.when(value.rlike(INT_PATTERN), "int")
        .when(value.rlike(FLOAT_PATTERN), "float")
        .when(F.lower(value).isin("true", "false"), "bool")
        .otherwise("string")
    )
    typed = lambda name, dtype: F.when(F.col("kind") == name, F.col("string_value")).try_cast(dtype)
    return (
        lines.filter(text.rlike(KEY_VALUE_PATTERN))
        .withColumn("key", F.regexp_extract(text, KEY_VALUE_PATTERN, 1))
        .withColumn("string_value", value)
        .withColumn("kind", kind)
        .withColumn("indent", F.length(F.regexp_extract(text, r"^(\s*)", 1)))
        .withColumn("int_value", typed("int", "bigint"))
        .withColumn("float_value", typed("float", "double"))
        .withColumn("bool_value", typed("bool", "boolean"))
    )


def _search(node, key):
    """First non-null value of ``key``: a mapping's own entry, else its children in order."""
    if isinstance(node, dict) and key in node:
        return node[key]
    children = node.values() if isinstance(node, dict) else node
    for child in children:
        if isinstance(child, dict) or (isinstance(child, list) and isinstance(node, dict)):
            if (hit := _search(child, key)) is not None:
                return hit
    return None


def deep_find(config: Column, key: str) -> Column:
    """Value of ``key`` anywhere in a nested JSON text, as text. Lists are searched one level deep.

    JSON objects keep the order of their keys here, which the search depends on; the built-in
    variant type sorts keys, so this is a small vectorized helper instead.
    """

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                node = json.loads(text)
            except (TypeError, ValueError):
                return None
            hit = _search(node, key) if isinstance(node, dict) else None
            return hit if hit is None or isinstance(hit, str) else json.dumps(hit)

        return texts.map(one)

    return find(config)
