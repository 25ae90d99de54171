"""Estimators that narrow a feature table, and the fitted models they return.

``fit`` runs a few aggregate jobs and leaves a state no larger than the table is wide; ``transform`` is
lazy and adds one row-local projection, so it also works on a streaming DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widetab.functions import vectors
from widetab.operators import matrix
from widetab.operators.layout import known_width, names_or_default
from widetab.operators.stats import feature_report


def _param(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=converter)


class Reducer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters shared by all methods; a method reads the ones it needs."""

    num_features = _param("num_features", "target width", TypeConverters.toInt)
    task_type = _param("task_type", "regression, binary or multiclass", TypeConverters.toString)
    seed = _param("seed", "seed of everything random", TypeConverters.toInt)
    names = _param("names", "input feature names, in order", TypeConverters.toListString)
    var_threshold = _param("var_threshold", "share t in the variance cut t(1-t)", TypeConverters.toFloat)
    num_tree_estimators = _param("num_tree_estimators", "trees of the importance forest", TypeConverters.toInt)
    max_depth = _param("max_depth", "depth of its trees; 0 is no limit", TypeConverters.toInt)
    fs_ratio = _param("fs_ratio", "selected share of the combined method", TypeConverters.toFloat)
    num_kbest_features = _param("num_kbest_features", "selected columns, instead of fs_ratio", TypeConverters.toInt)
    num_pca_comps = _param("num_pca_comps", "components, instead of fs_ratio", TypeConverters.toInt)
    num_ensemble = _param("num_ensemble", "views whose scores are averaged; 0 is a single view", TypeConverters.toInt)
    num_landmarks = _param("num_landmarks", "most kernel landmarks; no limit when unset", TypeConverters.toInt)
    kernel_share = _param("kernel_share", "share of the centred kernel that the landmarks span; 1 is exact", TypeConverters.toFloat)
    gamma = _param("gamma", "kernel width, 1/d when unset", TypeConverters.toFloat)
    alpha = _param("alpha", "L1 penalty, a tenth of the largest useful one when unset", TypeConverters.toFloat)
    tol = _param("tol", "tolerance of the L1 fit", TypeConverters.toFloat)
    max_iter = _param("max_iter", "iterations of the L1 fit", TypeConverters.toInt)
    strict = _param("strict", "keep only non-zero L1 coefficients", TypeConverters.toBoolean)
    epochs = _param("epochs", "passes of the gate training", TypeConverters.toInt)
    lr = _param("lr", "step size of the gate training", TypeConverters.toFloat)
    sigma = _param("sigma", "noise of a closed gate", TypeConverters.toFloat)

    method = ""

    def __init__(self, **params):
        super().__init__()
        self._setDefault(
            num_features=150, task_type="multiclass", seed=0, names=[], var_threshold=0.95,
            num_tree_estimators=10, max_depth=0, fs_ratio=0.75, num_ensemble=0, kernel_share=0.99,
            tol=1e-4, max_iter=3000, strict=False, epochs=50, lr=0.05, sigma=1.5,
        )
        self._set(**{k: v for k, v in params.items() if v is not None})

    def get(self, name: str):
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None

    def _width(self, df: DataFrame) -> int:
        return known_width(df, self.get("names"))

    def _target(self, d: int) -> int:
        k = self.get("num_features")
        if not 1 <= k <= d:
            raise ValueError(f"cannot keep {k} of {d} features")
        return k

    def fit_folds(self, df: DataFrame, folds: int, fold: str = "fold") -> dict[int, "ReducerModel"]:
        """A model per fold, each fitted on the rows of all *other* folds."""
        return {i: self.fit(df.filter(F.col(fold) != i)) for i in range(folds)}

    def _selector(self, d: int, indices: Sequence[int], report: DataFrame | None = None) -> "SelectorModel":
        names = names_or_default(self.get("names"), d)
        return SelectorModel([int(i) for i in indices], [names[i] for i in indices], report)


class ScoreSelector(Reducer):
    """A selector that turns one score per feature into the kept features."""

    def scores(self, df: DataFrame) -> DataFrame:
        """``(feature_idx, score)``; one row per feature."""
        raise NotImplementedError

    def choose(self, scores: list[tuple[int, float | None]]) -> list[int]:
        """Indices of the kept features, in output order."""
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> "SelectorModel":
        return self._from_scores(df.sparkSession, [tuple(r) for r in self.scores(df).select("feature_idx", "score").collect()])

    def _from_scores(self, spark: SparkSession, scores: list[tuple]) -> "SelectorModel":
        if not scores:
            raise ValueError("the table has no rows")
        chosen = self.choose(scores)
        frame = spark.createDataFrame(scores, "feature_idx int, score double")
        report = feature_report(frame, selected=F.col("feature_idx").isin(chosen))
        return self._selector(len(scores), chosen, report)


def best_first(scores: list[tuple[int, float | None]]) -> list[int]:
    """Feature indices by descending score; undefined scores last, ties by lowest index."""
    undefined = lambda s: s is None or s != s
    return [i for i, s in sorted(scores, key=lambda t: (undefined(t[1]), 0.0 if undefined(t[1]) else -t[1], t[0]))]


class ReducerModel(Model):
    """State: ``names_out`` and numpy arrays or plain lists, see ``_state``."""

    names_out: list[str]
    report: DataFrame | None = None

    def __init__(self):
        super().__init__()

    def _state(self) -> dict:
        raise NotImplementedError

    def save(self, path: str) -> None:
        """Write the state as one small parquet table."""
        spark = SparkSession.getActiveSession()
        rows = [("__class__", [], [], type(self).__name__)]
        for name, value in self._state().items():
            if isinstance(value, np.ndarray):
                flat = value.astype(float).ravel()
                rows += [(f"{name}#{i}", list(value.shape), flat[i : i + 65536].tolist(), None) for i in range(0, max(1, flat.size), 65536)]
            else:
                rows.append((name, [], [], json.dumps(value)))
        schema = "name string, shape array<int>, cells array<double>, text string"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> "ReducerModel":
        spark = SparkSession.getActiveSession()
        state, pieces, kind = {}, {}, None
        for r in spark.read.parquet(path).collect():
            if r["name"] == "__class__":
                kind = r["text"]
            elif r["text"] is not None:
                state[r["name"]] = json.loads(r["text"])
            else:
                name, start = r["name"].rsplit("#", 1)
                pieces.setdefault(name, []).append((int(start), r["shape"], r["cells"]))
        for name, found in pieces.items():
            found.sort()
            state[name] = np.concatenate([np.array(c, dtype=float) for _, _, c in found]).reshape(found[0][1])
        return MODELS[kind](**state)


class IdentityModel(ReducerModel):
    def __init__(self, names_out: Sequence[str]):
        super().__init__()
        self.names_out = list(names_out)

    def _state(self):
        return {"names_out": self.names_out}

    def _transform(self, df):
        return df


class SelectorModel(ReducerModel):
    """Keep the features at ``indices``, in that order."""

    def __init__(self, indices: Sequence[int], names_out: Sequence[str], report: DataFrame | None = None):
        super().__init__()
        self.indices, self.names_out, self.report = list(indices), list(names_out), report

    def _state(self):
        return {"indices": self.indices, "names_out": self.names_out}

    def _transform(self, df):
        return df.withColumn("features", vectors.take(F.col("features"), self.indices))


class ProjectionModel(ReducerModel):
    """``features @ components - offset``; ``variance`` holds the explained variance when known."""

    def __init__(self, components: np.ndarray, offset: np.ndarray, names_out: Sequence[str], variance: np.ndarray | None = None, total_variance: float | None = None):
        super().__init__()
        self.components, self.offset, self.names_out = components, offset, list(names_out)
        self.variance, self.total_variance = variance, total_variance

    def _state(self):
        state = {"components": self.components, "offset": self.offset, "names_out": self.names_out}
        if self.variance is not None:
            state |= {"variance": self.variance, "total_variance": self.total_variance}
        return state

    def _transform(self, df):
        return matrix.project(df, self.components, self.offset)


class PoolingModel(ReducerModel):
    """Mean of each cluster of features."""

    def __init__(self, clusters: Sequence[Sequence[int]], names_out: Sequence[str]):
        super().__init__()
        self.clusters, self.names_out = [list(c) for c in clusters], list(names_out)

    def _state(self):
        return {"clusters": self.clusters, "names_out": self.names_out}

    def _transform(self, df):
        return df.withColumn("features", vectors.pool(F.col("features"), self.clusters))


class KernelModel(ReducerModel):
    """``exp(-gamma |x - z|^2)`` against the landmarks, then a projection.

    ``residual`` is the share of the centred kernel of the fitted rows that the landmarks do not span.
    """

    def __init__(self, landmarks, gamma: float, components, offset, names_out: Sequence[str], variance=None, residual: float | None = None):
        super().__init__()
        self.landmarks, self.gamma, self.components, self.offset = landmarks, gamma, components, offset
        self.names_out, self.variance, self.residual = list(names_out), variance, residual

    def _state(self):
        state = {"landmarks": self.landmarks, "gamma": self.gamma, "components": self.components,
                 "offset": self.offset, "names_out": self.names_out, "residual": self.residual}
        return state if self.variance is None else state | {"variance": self.variance}

    def _transform(self, df):
        return matrix.kernel_project(df, self.landmarks, self.gamma, self.components, self.offset)


class SelectAndProjectModel(ReducerModel):
    """Selected features followed by a projection of the remaining ones, in the same row."""

    def __init__(self, selected, remaining, components, offset, names_out, report=None):
        super().__init__()
        self.selected, self.remaining = list(selected), list(remaining)
        self.components, self.offset, self.names_out, self.report = components, offset, list(names_out), report

    def _state(self):
        return {"selected": self.selected, "remaining": self.remaining, "components": self.components,
                "offset": self.offset, "names_out": self.names_out}

    def _transform(self, df):
        kept = df.withColumn("__kept", vectors.take(F.col("features"), self.selected))
        full = np.zeros((len(self.selected) + len(self.remaining), self.components.shape[1]))
        full[self.remaining] = self.components
        projected = matrix.project(kept, full, self.offset, out="__projected")
        return projected.withColumn("features", vectors.hconcat(F.col("__kept"), F.col("__projected"))).drop("__kept", "__projected")


MODELS = {c.__name__: c for c in (IdentityModel, SelectorModel, ProjectionModel, PoolingModel, KernelModel, SelectAndProjectModel)}

__all__ = ["Reducer", "ScoreSelector", "ReducerModel", "best_first", *MODELS]
