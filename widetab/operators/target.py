"""Ordered target statistics: categories as numbers, without a row seeing its own label (Prokhorenkova et al. 2018).

Rows are put into the order of a hash. The statistic of a training row is the smoothed mean of the labels of the rows with
the same category that stand before it; other rows get the mean over all training rows with the category.

The order is cut into even buckets of hashes. Sums per (feature, category, bucket) locate each bucket, and only the rows of
one bucket are ordered together, so a category with half of all rows is spread like the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widetab.functions.rng import HASH_BITS, hash52
from widetab.operators.layout import known_width
from widetab.session import cut_lineage

ROWS_PER_BUCKET = 4096


class TargetEncoder:
    """Replaces the features at ``categories`` by statistics of the label, put behind the other features.

    Regression and two classes give one statistic per category (the mean, or the share of class 1), more classes give
    the share of each. ``weight`` rows with the mean of all training rows are added to every category.
    """

    def __init__(self, categories: Sequence[int], task_type: str, classes: int = 0, seed: int = 0, weight: float = 1.0):
        self.categories, self.task_type, self.seed, self.weight = sorted(set(categories)), task_type, seed, weight
        self.wanted = [None] if task_type == "regression" else [1] if max(classes, 2) == 2 else list(range(classes))

    def _target(self) -> Column:
        label = F.col("label").cast("double")
        return F.array(*[label if c is None else (label == c).cast("double") for c in self.wanted])

    def _cells(self, df: DataFrame, *extra) -> DataFrame:
        """One row per category cell; a missing code is a category of its own."""
        cells = F.array(*[F.struct(F.lit(i).alias("feature_idx"), F.get("features", F.lit(i)).alias("value")) for i in self.categories])
        return df.select("row_id", *extra, F.inline(cells))

    def fit(self, df: DataFrame) -> "TargetStatistics":
        known_width(df)
        target = df.select(self._target().alias("y"))
        prior = target.select(*[F.avg(F.get("y", F.lit(i))) for i in range(len(self.wanted))]).first()
        if prior[0] is None:
            raise ValueError("the table has no rows")
        sums = [F.sum(F.get("y", F.lit(i))).alias(f"s{i}") for i in range(len(self.wanted))]
        table = self._cells(df, self._target().alias("y")).groupBy("feature_idx", "value").agg(F.count(F.lit(1)).alias("n"), *sums)
        return TargetStatistics(self, [float(p) for p in prior], cut_lineage(table))


class TargetStatistics:
    """``table``: ``(feature_idx, value, n, s0, ...)``, rows and label sums of every category of the training rows."""

    def __init__(self, encoder: TargetEncoder, prior: list[float], table: DataFrame):
        self.encoder, self.prior, self.table = encoder, prior, table

    def _mean(self, n: Column, sums: list[Column]) -> Column:
        w = F.lit(float(self.encoder.weight))
        return F.array(*[(F.coalesce(s, F.lit(0.0)) + w * F.lit(p)) / (F.coalesce(n, F.lit(0)) + w) for s, p in zip(sums, self.prior)])

    def _gathered(self, df: DataFrame, cells: DataFrame) -> DataFrame:
        """Put the statistics of each row behind its other features."""
        taken = set(self.encoder.categories)
        others = [i for i in range(known_width(df)) if i not in taken]
        lists = cells.groupBy("row_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("feature_idx", "mean"))), lambda c: c["mean"])).alias("__stats"))
        kept = F.array(*[F.get("features", F.lit(i)) for i in others]) if others else F.array().cast("array<double>")
        joined = df.join(lists, "row_id")
        return joined.select(*[F.concat(kept, F.col("__stats")).alias(c) if c == "features" else F.col(f"`{c}`") for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows that were not trained on: means over all training rows of the category, the overall mean if there are none."""
        cells = self.encoder._cells(df).alias("c")
        table = self.table.alias("t")
        same = (F.col("c.feature_idx") == F.col("t.feature_idx")) & F.col("c.value").eqNullSafe(F.col("t.value"))
        found = cells.join(table, same, "left")
        mean = self._mean(F.col("n"), [F.col(f"s{i}") for i in range(len(self.prior))])
        return self._gathered(df, found.select("row_id", F.col("c.feature_idx").alias("feature_idx"), mean.alias("mean")))

    def transform_training(self, df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
        """The training rows themselves: means over the rows of the category that come before in the order of the hash."""
        return self._gathered(df, self.ordered(df, rows_per_bucket))

    def ordered(self, df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
        """``(row_id, feature_idx, mean)`` of the training rows."""
        total = sum(r["n"] for r in self.table.filter(F.col("feature_idx") == self.encoder.categories[0]).groupBy().agg(F.sum("n").alias("n")).collect())
        bits = max(0, (max(total // rows_per_bucket, 1)).bit_length() - 1)
        key = hash52(self.encoder.seed, F.col("row_id"))
        rows = df.select("row_id", "features", key.alias("_key"), self.encoder._target().alias("y"))
        cells = self.encoder._cells(rows, "_key", "y", F.shiftright("_key", HASH_BITS - bits).alias("_bucket"))
        parts = range(len(self.prior))
        group = ["feature_idx", "value", "_bucket"]
        sums = [F.sum(F.get("y", F.lit(i))) for i in parts]
        totals = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *[s.alias(f"_s{i}") for i, s in enumerate(sums)])
        before = Window.partitionBy("feature_idx", "value").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = totals.select(*[F.col(c).alias(f"__{c}") for c in group], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in totals.columns[3:]])
        inside = Window.partitionBy(*group).orderBy("_key", "row_id").rowsBetween(Window.unboundedPreceding, -1)
        own = cells.select("row_id", *group, F.count(F.lit(1)).over(inside).alias("_n"), *[F.coalesce(s.over(inside), F.lit(0.0)).alias(f"_s{i}") for i, s in enumerate(sums)])
        same = (F.col("feature_idx") == F.col("__feature_idx")) & F.col("value").eqNullSafe(F.col("__value")) & (F.col("_bucket") == F.col("___bucket"))
        found = own.join(placed, same)
        mean = self._mean(F.col("_n") + F.col("_before_n"), [F.col(f"_s{i}") + F.col(f"_before_s{i}") for i in parts])
        return found.select("row_id", "feature_idx", mean.alias("mean"))
