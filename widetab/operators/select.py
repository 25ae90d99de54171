"""Methods that keep a subset of the features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widetab.functions import vectors
from widetab.functions.rng import hash52
from widetab.operators import extra_trees, lasso, matrix, stats
from widetab.operators.base import IdentityModel, Reducer, ReducerModel, ScoreSelector, best_first
from widetab.operators.layout import known_width, names_or_default


class Original(Reducer):
    """Keep everything."""

    method = "original"

    def _fit(self, df: DataFrame) -> IdentityModel:
        return IdentityModel(names_or_default(self.get("names"), self._width(df)))


def sampled_features(spark: SparkSession, d: int, k: int, seed: int) -> DataFrame:
    """``(feature_idx, position)`` of ``k`` features drawn without replacement, by hashed order."""
    drawn = spark.range(d).select(F.col("id").cast("int").alias("feature_idx"), hash52(seed, F.col("id")).alias("h"))
    return stats.feature_report(drawn.select("feature_idx", (-F.col("h")).cast("double").alias("score"))).filter(
        F.col("rank") <= k
    ).select("feature_idx", (F.col("rank") - 1).alias("position"))


class RandomSelector(Reducer):
    """``num_features`` random features in sampled order."""

    method = "random_fs"

    def _fit(self, df: DataFrame) -> ReducerModel:
        d = self._width(df)
        drawn = sampled_features(df.sparkSession, d, self._target(d), self.get("seed"))
        return self._selector(d, [r["feature_idx"] for r in drawn.orderBy("position").collect()])


class VarianceSelector(ScoreSelector):
    """Features whose population variance is strictly above ``t (1 - t)``, in original order."""

    method = "variance_fs"

    def scores(self, df):
        return stats.feature_moments(df).select("feature_idx", F.col("var_pop").alias("score"))

    def choose(self, scores):
        cut = stats.variance_cut(self.get("var_threshold"))
        kept = sorted(i for i, s in scores if s is not None and s > cut)
        if not kept:
            raise ValueError(f"no feature has a variance above {cut}")
        return kept

    def fit_folds(self, df, folds, fold="fold"):
        moments = stats.training_moments(stats.feature_moments(df, [fold]), folds, fold)
        return _fold_models(self, moments.select(fold, "feature_idx", F.col("var_pop").alias("score")), folds, fold)


class KBestSelector(ScoreSelector):
    """The ``num_features`` features with the largest univariate F, in original order."""

    method = "kbest_fs"

    def scores(self, df):
        return stats.univariate_scores(df, self.get("task_type"))

    def choose(self, scores):
        return sorted(best_first(scores)[: self._target(len(scores))])

    def fit_folds(self, df, folds, fold="fold"):
        if self.get("task_type") == "regression":
            return super().fit_folds(df, folds, fold)
        cells = df.select(F.col(fold), "label", "features")
        moments = stats.training_moments(stats.feature_moments(cells, [fold, "label"]), folds, fold)
        return _fold_models(self, stats.anova_from_moments(moments, [fold]), folds, fold)


def _fold_models(selector: ScoreSelector, scores: DataFrame, folds: int, fold: str) -> dict[int, ReducerModel]:
    """Models of all folds from one scan: folds x width small rows reach the driver."""
    found: dict[int, list] = {i: [] for i in range(folds)}
    for r in scores.select(fold, "feature_idx", "score").collect():
        found[r[fold]].append((r["feature_idx"], r["score"]))
    return {i: selector._from_scores(scores.sparkSession, sorted(s)) for i, s in found.items()}


class TreeSelector(ScoreSelector):
    """Features whose importance in extremely randomised trees is at least the mean importance, in original order.

    ``max_depth`` 0 grows every tree until its leaves are pure, see :mod:`widetab.operators.extra_trees`.
    """

    method = "tree_fs"

    def scores(self, df):
        return extra_trees.importances(
            df, self.get("num_tree_estimators"), self.get("seed"), self.get("task_type") == "regression", max_depth=self.get("max_depth") or None,
        )

    def choose(self, scores):
        mean = sum(s for _, s in scores) / len(scores)
        return sorted(i for i, s in scores if s >= mean)


class LassoSelector(ScoreSelector):
    """The ``num_features`` features with the largest L1-model coefficients, in original order.

    Features are standardised for the fit only; the kept columns are the raw ones. Without ``strict``
    exactly ``num_features`` features are kept and zero coefficients fill up by lowest index.
    """

    method = "lasso_fs"

    def scores(self, df):
        scales = stats.standard_scales(df).orderBy("feature_idx").collect()
        z = vectors.standardize(F.col("features"), [r["mean"] for r in scales], [r["scale"] for r in scales])
        rows = df.select(array_to_vector(z).alias("v"), F.col("label").cast("double").alias("y")).persist()
        common = dict(
            featuresCol="v", labelCol="y", elasticNetParam=1.0, standardization=False,
            tol=self.get("tol"), maxIter=self.get("max_iter"),
        )
        try:
            if self.get("task_type") == "regression":
                alpha = self.get("alpha")
                if alpha is None:
                    alpha = stats.lasso_alpha_max(df).first()["alpha"]
                coefficients = [LinearRegression(regParam=alpha, **common).fit(rows).coefficients.toArray()]
            else:
                family = "binomial" if self.get("task_type") == "binary" else "multinomial"
                model = LogisticRegression(regParam=1.0 / rows.count(), family=family, **common).fit(rows)
                coefficients = list(model.coefficientMatrix.toArray())
        finally:
            rows.unpersist()
        totals = [float(sum(abs(c[i]) for c in coefficients)) for i in range(len(scales))]
        return df.sparkSession.createDataFrame(list(enumerate(totals)), "feature_idx int, score double")

    def fit_folds(self, df, folds, fold="fold"):
        """Regression on a table that is not too wide takes the models of all folds from one scan."""
        if self.get("task_type") != "regression" or not matrix.fold_matrices_fit(known_width(df) + 1, folds):
            return super().fit_folds(df, folds, fold)
        found = lasso.fold_coefficients(df, folds, fold, self.get("alpha"), self.get("max_iter"))
        return {i: self._from_scores(df.sparkSession, [(j, abs(float(v))) for j, v in enumerate(beta)]) for i, beta in enumerate(found)}

    def choose(self, scores):
        kept = best_first(scores)[: self._target(len(scores))]
        value = dict(scores)
        return sorted(i for i in kept if value[i] > 0 or not self.get("strict"))


def view_moments(df: DataFrame, views: int, seed: int) -> DataFrame:
    """Class moments per view: a row belongs to all views but the one its hash names.

    Every view therefore has ``(views - 1) / views`` of the rows, from a single scan.
    """
    view = F.pmod(hash52(seed, F.col("row_id")), F.lit(views)).cast("int")
    cells = df.select(view.alias("view_id"), "label", "features")
    return stats.training_moments(stats.feature_moments(cells, ["view_id", "label"]), views, "view_id")


def view_scores(df: DataFrame, views: int, seed: int) -> DataFrame:
    """``(view_id, feature_idx, score)``: ANOVA F inside each view."""
    return stats.anova_from_moments(view_moments(df, views, seed), ["view_id"])


def ensemble_topk(scores: DataFrame, k: int) -> DataFrame:
    """``k`` features with the largest signed mean score over ``(view_id, feature_idx, score)``."""
    return stats.top_k(stats.mean_over_views(scores), k)


class EnsembleSelector(ScoreSelector):
    """Scores averaged over views of the rows; the best features in descending order.

    With fewer than two views the scores come from all rows.
    """

    method = "tabpfn_fs"

    def scores(self, df):
        views, regression = self.get("num_ensemble"), self.get("task_type") == "regression"
        if views < 2:
            return stats.univariate_scores(df, self.get("task_type"))
        if not regression:
            return stats.mean_over_views(view_scores(df, views, self.get("seed")))
        view = F.pmod(hash52(self.get("seed"), F.col("row_id")), F.lit(views))
        parts = [
            stats.regression_scores(df.filter(view != v)).withColumn("view_id", F.lit(v)) for v in range(views)
        ]
        scores = parts[0]
        for part in parts[1:]:
            scores = scores.unionByName(part)
        return stats.mean_over_views(scores)

    def choose(self, scores):
        return best_first(scores)[: self._target(len(scores))]
