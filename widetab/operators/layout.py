"""The feature-table layout ``(row_id, label, features ARRAY<DOUBLE>)`` and its long and wide forms.

One aggregate per top-level column makes plans that grow with the width and give up code generation;
one array column keeps the plan the same size for 10 or 10,000 features. Feature names travel beside
the table as an ordered Python list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widetab.functions import vectors
from widetab.session import cut_lineage

BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when it is known to be small; leave the join to Spark otherwise.

    The size is taken from a bounded look at the rows, so a large table costs one short job.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def columns_by_type(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``number``, ``string``, ``boolean`` or ``datetime`` columns, in table order."""
    kinds = {
        "number": T.NumericType,
        "string": (T.StringType, T.CharType, T.VarcharType),
        "boolean": T.BooleanType,
        "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    }
    if kind not in kinds:
        raise ValueError(f"unknown column kind {kind!r}")
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds[kind])]


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Category columns as plain strings: the named ones, or all CHAR and VARCHAR columns. Missing values stay missing."""
    bounded = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.CharType, T.VarcharType))]
    chosen = set(columns) if columns is not None else set(bounded)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def number(name: str, dtype: T.DataType) -> Column:
    """A column as DOUBLE with NaN turned into NULL, so that averages skip it."""
    value = F.col(f"`{name}`").cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def to_array(df: DataFrame, features: Sequence[str], label: str | None, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Gather named columns into the array layout."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [number(c, types[c]) for c in features]
    target = [F.col(f"`{label}`").alias("label")] if label else []
    gathered = F.array(*cells) if cells else F.array().cast("array<double>")
    return df.select(
        F.col(f"`{row_id}`").alias("row_id"), *target, *[F.col(c) for c in keep], gathered.alias("features")
    )


def from_array(df: DataFrame, column: str, label: Column, row_id: str) -> DataFrame:
    """Array layout from an existing array column; FLOAT becomes DOUBLE before anything is summed."""
    values = F.col(column).cast("array<double>")
    return df.select(F.col(row_id).alias("row_id"), label.alias("label"), values.alias("features"))


def to_long(df: DataFrame, keys: Sequence[str] = ("row_id", "label"), features: str = "features") -> DataFrame:
    """One row per cell: keys, ``feature_idx``, ``value``."""
    return df.select(*keys, F.posexplode(features).alias("feature_idx", "value"))


def to_wide(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("row_id", "label"), features: str = "features") -> DataFrame:
    """One top-level column per feature, for hand-over to other tools."""
    return df.select(*keys, *[F.get(F.col(features), F.lit(i)).alias(n) for i, n in enumerate(names)])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give rows an id once and write it down, so that it can never change when a task is retried."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def width(df: DataFrame, features: str = "features") -> int:
    """Number of features after checking that all rows agree, which reads the whole table."""
    low, high = df.agg(F.min(F.size(features)), F.max(F.size(features))).first()
    if low is None:
        raise ValueError("the table has no rows")
    if low != high:
        raise ValueError(f"rows have between {low} and {high} features")
    return int(low)


def known_width(df: DataFrame, names: Sequence[str] | None = None, features: str = "features") -> int:
    """Number of features from their names, else from one row: methods that do not look at the data must
    not scan it. Rows of another width fail in the statistics and matrix operators."""
    if names:
        return len(names)
    row = df.select(F.size(features)).first()
    if row is None:
        raise ValueError("the table has no rows")
    return int(row[0])


def names_or_default(names: Sequence[str] | None, d: int) -> list[str]:
    names = list(names) if names else [f"f{i}" for i in range(d)]
    if len(names) != d:
        raise ValueError(f"{len(names)} names for {d} features")
    return names


def select_features(df: DataFrame, indices: Sequence[int], features: str = "features", out: str | None = None) -> DataFrame:
    """Keep the features at ``indices`` in list order."""
    return df.withColumn(out or features, vectors.take(F.col(features), indices))
