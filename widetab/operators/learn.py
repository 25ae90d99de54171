"""Learners on the narrowed table, bagging with out-of-fold predictions, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widetab.functions import vectors
from widetab.operators import matrix, metrics
from widetab.operators.base import Reducer, ReducerModel, SelectorModel
from widetab.operators.boosting import HistogramBoosting
from widetab.operators.layout import known_width
from widetab.operators.split import kfold


class Learner(Protocol):
    """``fit`` on ``(row_id, label, features)`` gives a model whose ``predict`` adds ``prediction`` and,
    for classification, ``probability ARRAY<DOUBLE>``."""

    def fit(self, df: DataFrame) -> "LearnerModel": ...


class LearnerModel(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...


class SparkLearner:
    """A Spark ML estimator behind the learner interface."""

    def __init__(self, task_type: str, classes: int = 0, seed: int = 0, **params):
        self.task_type, self.classes, self.seed, self.params = task_type, classes, seed, params

    def estimator(self):
        raise NotImplementedError

    def fit(self, df: DataFrame) -> "SparkLearnerModel":
        rows = df.select(array_to_vector("features").alias("v"), F.col("label").cast("double").alias("y"))
        return SparkLearnerModel(self.estimator().fit(rows), self.task_type, self.classes)


class SparkLearnerModel:
    def __init__(self, model, task_type: str, classes: int):
        self.model, self.task_type, self.classes = model, task_type, classes

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df.withColumn("v", array_to_vector("features")))
        if self.task_type == "regression":
            return scored.select(*df.columns, F.col("prediction"))
        if "probability" in scored.columns:
            given = vector_to_array("probability")
        else:
            given = one_vs_rest_probability(vector_to_array("rawPrediction"))
        padded = F.concat(given, F.array_repeat(F.lit(0.0), F.greatest(F.lit(self.classes) - F.size(given), F.lit(0))))
        return scored.select(*df.columns, F.col("prediction"), padded.alias("probability"))


def one_vs_rest_probability(margins: Column) -> Column:
    """Class probabilities from one boosted margin per class, normalised to sum to one."""
    single = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = lambda p: F.greatest(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), F.lit(1e-300))
    return vectors.bind(single, lambda p: vectors.bind(total(p), lambda t: F.transform(p, lambda v: v / t)))


class BoostedTrees(SparkLearner):
    """The boosted trees of Spark ML; one model per class when there are more than two."""

    def estimator(self):
        common = dict(featuresCol="v", labelCol="y", seed=self.seed, **{"maxIter": 20, "maxDepth": 5, **self.params})
        if self.task_type == "regression":
            return GBTRegressor(**common)
        trees = GBTClassifier(**common)
        if self.task_type == "binary":
            return trees
        return OneVsRest(classifier=trees, featuresCol="v", labelCol="y", rawPredictionCol="rawPrediction", parallelism=2)


class LinearModel(SparkLearner):
    """Linear or (multinomial) logistic regression."""

    def estimator(self):
        common = dict(featuresCol="v", labelCol="y", **{"maxIter": 50, "regParam": 1e-3, **self.params})
        return LinearRegression(**common) if self.task_type == "regression" else LogisticRegression(**common)


class Forest(SparkLearner):
    """Random forest."""

    def estimator(self):
        common = dict(featuresCol="v", labelCol="y", seed=self.seed, **{"numTrees": 50, "maxDepth": 8, **self.params})
        return RandomForestRegressor(**common) if self.task_type == "regression" else RandomForestClassifier(**common)


LEARNERS: dict[str, Callable[..., Learner]] = {
    "gbt": HistogramBoosting,
    "catboost_tab": HistogramBoosting,
    "spark_gbt": BoostedTrees,
    "linear": LinearModel,
    "forest": Forest,
}


def register_learner(key: str, factory: Callable[..., Learner]) -> None:
    LEARNERS[key.lower()] = factory


def make_learner(key: str, **params) -> Learner:
    key = key.lower()
    if key not in LEARNERS:
        raise ValueError(f"unknown learner {key!r}; known: {sorted(LEARNERS)}")
    return LEARNERS[key](**params)


def run_parallel(spark, jobs: list[Callable], parallelism: int) -> list:
    """Independent Spark jobs from a few driver threads, results in order."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    wrapped = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(job) for job in wrapped]]


class BaggedModel:
    """Fold models, their out-of-fold predictions and score, and the model used for new rows.

    A learner fitted without folds has neither predictions nor scores of that kind.
    """

    def __init__(self, oof: DataFrame | None, val_scores: dict, folds: list, refit: tuple | None, task_type: str):
        self.oof, self.val_scores, self.folds, self.refit, self.task_type = oof, val_scores, folds, refit, task_type

    def predict(self, df: DataFrame) -> DataFrame:
        """By the model refitted on all training rows, or by the mean of the fold models."""
        if self.refit is not None:
            reducer, learner = self.refit
            return learner.predict(reducer.transform(df) if reducer else df)
        scored = df.withColumn("__raw", F.col("features"))
        output = "prediction" if self.task_type == "regression" else "probability"
        for i, (reducer, learner) in enumerate(self.folds):
            scored = scored.withColumn("features", F.col("__raw"))
            scored = learner.predict(reducer.transform(scored) if reducer else scored)
            scored = scored.withColumnRenamed(output, f"__p{i}")
            if output == "probability":
                scored = scored.drop("prediction")
        parts = [F.col(f"__p{i}") for i in range(len(self.folds))]
        kept = [F.col("__raw").alias("features") if c == "features" else F.col(c) for c in df.columns]
        if output == "prediction":
            total = parts[0]
            for p in parts[1:]:
                total = total + p
            return scored.select(*kept, (total / len(parts)).alias("prediction"))
        total = parts[0]
        for p in parts[1:]:
            total = F.zip_with(total, p, lambda a, b: a + b)
        mean = F.transform(total, lambda v: v / len(parts))
        best = (F.array_position(mean, F.array_max(mean)) - 1).cast("double")
        return scored.select(*kept, best.alias("prediction"), mean.alias("probability"))

    def score(self, df: DataFrame) -> dict[str, float]:
        return metrics.evaluate(self.predict(df), self.task_type)

    def release(self) -> None:
        """Give up the stored out-of-fold predictions."""
        if self.oof is not None:
            self.oof.unpersist()


def fit_alone(df: DataFrame, learner: Learner, reducer: Reducer | ReducerModel | None = None, task_type: str = "multiclass") -> BaggedModel:
    """One learner on all rows, without folds and so without a validation score."""
    fitted = reducer.fit(df) if isinstance(reducer, Reducer) else reducer
    return BaggedModel(None, {}, [], (fitted, learner.fit(fitted.transform(df) if fitted else df)), task_type)


def bag(
    df: DataFrame, learner: Learner, reducer: Reducer | ReducerModel | None = None, folds: int = 8, task_type: str = "multiclass",
    seed: int = 0, mode: str = "refit", parallelism: int = 4,
) -> BaggedModel:
    """k-fold bagging. With a ``reducer`` it is fitted inside every training fold only; one that is
    already fitted is applied as it is.

    Reducers whose statistics are sums are fitted for all folds from one scan (:meth:`Reducer.fit_folds`), and so are
    learners that have a ``fit_folds`` of their own when every fold sees a choice of the same features. Otherwise the folds are
    independent and run as concurrent jobs. Fold rows are kept while the folds are fitted.
    """
    if mode not in ("refit", "mean"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    label = None if task_type == "regression" else "label"
    folded = kfold(df, folds, seed, label).persist()
    reducers: dict[int, ReducerModel | None] = (
        reducer.fit_folds(folded, folds) if isinstance(reducer, Reducer) else dict.fromkeys(range(folds), reducer)
    )

    whole = reducer.fit(df) if isinstance(reducer, Reducer) and mode == "refit" else None if isinstance(reducer, Reducer) else reducer
    selected = [reducers[i] for i in range(folds)] + ([whole] if whole is not None else [])
    selecting = isinstance(reducer, Reducer) and all(isinstance(m, SelectorModel) for m in selected)
    shared = hasattr(learner, "fit_folds") and (selecting or not isinstance(reducer, Reducer))
    together = None
    if shared and selecting:
        choices = [m.indices for m in selected]
        together = learner.fit_folds(folded, folds, selections=choices if whole is not None else [*choices, choices[0]])
    elif shared:
        together = learner.fit_folds(folded if reducer is None else reducer.transform(folded), folds)

    def one(i: int):
        narrow = (lambda rows: reducers[i].transform(rows)) if reducers[i] is not None else (lambda rows: rows)
        model = together[i] if shared else learner.fit(narrow(folded.filter(F.col("fold") != i)))
        predicted = model.predict(narrow(folded.filter(F.col("fold") == i)))
        return model, predicted.drop("features")

    fitted = run_parallel(spark, [lambda i=i: one(i) for i in range(folds)], parallelism)
    oof = fitted[0][1]
    for _, part in fitted[1:]:
        oof = oof.unionByName(part)
    oof = oof.persist()
    val_scores = metrics.evaluate(oof, task_type)
    refit = None
    if mode == "refit":
        refit = (whole, together[folds] if shared else learner.fit(whole.transform(df) if whole else df))
    folded.unpersist()
    return BaggedModel(oof, val_scores, [(reducers[i], fitted[i][0]) for i in range(folds)], refit, task_type)


def score_with(df: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], out: str = "prediction", outputs: int = 1) -> DataFrame:
    """Batch scoring with any ``rows x features -> rows`` (or ``rows x outputs``) function.

    The predictor is broadcast once per executor and applied to Arrow batches; nothing is shuffled.
    """
    d = known_width(df)
    # Broadcast values use plain pickle, which has no closures, so the function travels as bytes.
    packed = cloudpickle.dumps(predictor)
    if len(packed) > matrix.MAX_BROADCAST_BYTES:
        raise ValueError(f"a predictor of {len(packed)} bytes is too large to broadcast; let it load its weights from a shared path")
    shared = df.sparkSession.sparkContext.broadcast(packed)
    names, position = df.columns, df.columns.index("features")
    dtype = T.DoubleType() if outputs == 1 else T.ArrayType(T.DoubleType())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = cloudpickle.loads(shared.value)
        for batch in batches:
            result = np.asarray(apply(matrix.batch_matrix(batch.column(position), d)), dtype=np.float64)
            column = pa.array(result.reshape(-1)) if outputs == 1 else matrix.list_column(result)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, out])

    return df.mapInArrow(predict, T.StructType([*df.schema.fields, T.StructField(out, dtype)]))
