"""Filling missing values: numbers by their mean, strings by their mode.

Statistics come from the training rows. ``own_stats=True`` fills a table from its own statistics
instead, also a test table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.functions import vectors
from widetab.operators import stats
from widetab.operators.layout import columns_by_type


class ColumnImputer(Estimator):
    """Fit means and modes of named columns; numeric columns become DOUBLE."""

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> "ColumnImputerModel":
        columns = set(self.columns if self.columns is not None else df.columns)
        numbers = [c for c in columns_by_type(df, "number") if c in columns]
        strings = [c for c in columns_by_type(df, "string") if c in columns]
        # One value per column: as many rows as the table is wide.
        means = {r["column"]: r["mean"] for r in stats.column_means(df, numbers).collect()} if numbers else {}
        modes = {r["column"]: r["mode"] for r in stats.column_modes(df, strings).collect()} if strings else {}
        return ColumnImputerModel(
            {c: means.get(c, 0.0) for c in numbers}, {c: modes.get(c, "missing") for c in strings}
        )


class ColumnImputerModel(Model):
    def __init__(self, means: dict[str, float], modes: dict[str, str]):
        super().__init__()
        self.means, self.modes = means, modes

    def _transform(self, df: DataFrame) -> DataFrame:
        def cell(name: str):
            column = F.col(f"`{name}`")
            if name in self.means:
                value = column.cast("double")
                return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(float(self.means[name]))).alias(name)
            if name in self.modes:
                return F.coalesce(column, F.lit(self.modes[name])).alias(name)
            return column

        return df.select(*[cell(c) for c in df.columns])


class FeatureImputer(Estimator):
    """The same for the array layout: all features are numbers and take their mean."""

    def _fit(self, df: DataFrame) -> "FeatureImputerModel":
        rows = stats.feature_means(df).orderBy("feature_idx").collect()
        return FeatureImputerModel([r["mean"] for r in rows])


class FeatureImputerModel(Model):
    def __init__(self, means: Sequence[float]):
        super().__init__()
        self.means = list(means)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", vectors.fill(vectors.nan_to_null(F.col("features")), self.means))


def impute_parts(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None, own_stats: bool = False):
    """Both parts filled from training statistics (or each from its own)."""
    imputer = ColumnImputer(columns)
    model = imputer.fit(train)
    return model.transform(train), (imputer.fit(test) if own_stats else model).transform(test)
