import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.operators import learn
from widetab.operators.base import ScoreSelector
from widetab.operators.learn import bag, make_learner, score_with
from widetab.operators.registry import REDUCERS, make_reducer, register_reducer
from widetab.plans import experiment
from widetab.plans.experiment import Experiment
from widetab.sources import results as result_files


@pytest.fixture
def classes(spark, planted):
    x, score, _ = planted
    return frame(spark, x, np.digitize(score, [-1, 1]))


@pytest.mark.parametrize("key", ["gbt", "linear", "forest"])
@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
def test_learners(spark, planted, key, task):
    x, score, signal = planted
    y = {"binary": (score > 0).astype(int), "regression": score, "multiclass": np.digitize(score, [-1, 1])}[task]
    df = frame(spark, x[:, signal], y)
    small = {"gbt": dict(maxIter=3, maxDepth=2), "linear": {}, "forest": dict(numTrees=5)}[key]
    out = make_learner(key, task_type=task, classes=3 if task == "multiclass" else 2, **small).fit(df).predict(df).collect()
    error = np.mean([abs(r["prediction"] - r["label"]) for r in out])
    assert error < np.abs(y - np.median(y)).mean()
    if task != "regression":
        assert all(np.isclose(sum(r["probability"]), 1) and len(r["probability"]) == (3 if task == "multiclass" else 2) for r in out)


def test_probabilities_are_padded_for_classes_missing_in_training(spark, classes):
    model = make_learner("linear", task_type="multiclass", classes=5).fit(classes)
    assert {len(r["probability"]) for r in model.predict(classes).collect()} == {5}


def test_unknown_learner():
    with pytest.raises(ValueError, match="unknown learner"):
        make_learner("oracle")


def test_out_of_fold_covers_every_row_once(spark, classes):
    bagged = bag(classes, make_learner("linear", task_type="multiclass", classes=3), make_reducer("kbest_fs", num_features=4), folds=4)
    rows = bagged.oof.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(200))
    assert bagged.val_scores["log_loss"] < np.log(3)
    assert bagged.score(classes)["log_loss"] < np.log(3)


def test_out_of_fold_predictions_ignore_the_held_out_labels(spark, planted):
    x, score, _ = planted
    learner = make_learner("linear", task_type="regression")
    predict = lambda y: {r["row_id"]: r["prediction"] for r in bag(frame(spark, x, y), learner, make_reducer("kbest_fs", num_features=4, task_type="regression"), folds=4, task_type="regression", mode="mean").oof.filter("fold = 1").collect()}
    before = predict(score)
    held_out = list(before)
    changed = score.copy()
    changed[held_out] += 100.0
    after = predict(changed)
    assert all(np.isclose(before[i], after[i]) for i in held_out)


@pytest.mark.parametrize("task", ["multiclass", "regression"])
def test_mean_of_fold_models(spark, planted, task):
    x, score, _ = planted
    y = score if task == "regression" else np.digitize(score, [-1, 1])
    df = frame(spark, x, y)
    bagged = bag(df, make_learner("linear", task_type=task, classes=3), make_reducer("pca_dr", num_features=20), folds=3, task_type=task, mode="mean")
    out = bagged.predict(df)
    assert out.columns[:3] == df.columns and np.allclose(to_numpy(out), x)
    column = "prediction" if task == "regression" else "probability"
    parts = [to_numpy(m.predict(r.transform(df)), column) for r, m in bagged.folds]
    assert np.allclose(to_numpy(out, column), np.mean(parts, axis=0))


def test_any_predictor_scores_in_batches(spark, planted):
    x = planted[0]
    shift = 2.0
    one = score_with(frame(spark, x), lambda rows: rows.sum(axis=1) + shift)
    assert np.allclose(to_numpy(one, "prediction"), x.sum(axis=1) + shift)
    two = score_with(frame(spark, x), lambda rows: rows[:, :2], out="p", outputs=2)
    assert np.allclose(to_numpy(two, "p"), x[:, :2])


def test_own_method_and_learner_can_be_registered(spark, classes):
    class FirstColumns(ScoreSelector):
        method = "first_fs"

        def scores(self, df):
            return df.sparkSession.range(30).select(F.col("id").cast("int").alias("feature_idx"), (-F.col("id")).cast("double").alias("score"))

        def choose(self, scores):
            return list(range(self.get("num_features")))

    register_reducer(FirstColumns)
    learn.register_learner("Mine", lambda **kw: make_learner("linear", **kw))
    try:
        exp = Experiment("d", model="mine", methods=("first_fs",), num_features=3, num_repeats=1, num_folds=1, num_k_folds=2)
        results, errors = experiment.run(classes, exp)
        assert results.count() == 1 and errors.count() == 0
    finally:
        REDUCERS.pop("first_fs")
        learn.LEARNERS.pop("mine")


def test_failures_are_isolated_and_counted(spark, classes):
    exp = Experiment("d", model="linear", methods=("kbest_fs", "variance_fs", "magic"), num_features=4, num_repeats=1, num_folds=2, num_k_folds=2,
                     method_params={"variance_fs": {"var_threshold": 0.5}, "kbest_fs": {}}, seed=7)
    results, errors = experiment.run(classes.withColumn("features", F.transform("features", lambda v: v * 0.01)), exp)
    rows = results.orderBy("fold").collect()
    assert [(r["method"], r["fold"], r["seed"], r["metric"]) for r in rows] == [("kbest_fs", 0, 7, "log_loss"), ("kbest_fs", 1, 7, "log_loss")]
    assert all(r["fold_time"] > 0 and r["val_score"] is not None and r["norm_rmse"] is None for r in rows)
    failed = {(r["method"], r["fold"]): r["message"] for r in errors.collect()}
    assert set(failed) == {(m, f) for m in ("variance_fs", "magic") for f in (0, 1)}
    assert "unknown method" in failed["magic", 0] and "variance" in failed["variance_fs", 1]


def test_everything_failed_gives_empty_results_with_the_schema(spark, classes):
    results, errors = experiment.run(classes, Experiment("d", methods=("magic",), num_repeats=1, num_folds=1))
    assert results.count() == 0 and "score" in results.columns and errors.count() == 1


def test_appended_test_rows_are_one_unit(spark, planted):
    x, score, _ = planted
    df = frame(spark, x, score).withColumn("is_test", F.col("row_id") >= 150)
    exp = Experiment("d", model="linear", methods=("original",), task_type="regression", num_k_folds=2, scope="split", save_time=False)
    row = experiment.run(df, exp)[0].collect()
    assert len(row) == 1 and row[0]["metric"] == "rmse" and row[0]["fold_time"] is None
    assert np.isclose(row[0]["norm_rmse"], row[0]["score"] / score[150:].std())


def test_published_splits(spark, classes):
    rows = [(i, r, 0, "test" if (i + r) % 3 == 0 else "train") for i in range(200) for r in range(2)]
    splits = spark.createDataFrame(rows, "row_id bigint, repeat int, fold int, part string")
    exp = Experiment("d", model="linear", methods=("random_fs",), num_features=5, num_repeats=2, num_folds=1, num_k_folds=2, scope="split")
    results, errors = experiment.run(classes, exp, splits)
    assert results.count() == 2 and errors.count() == 0
    train, test = experiment.split_parts(classes, splits, exp, "multiclass", 1, 0)
    assert sorted(r[0] for r in test.select("row_id").collect()) == [i for i in range(200) if (i + 1) % 3 == 0]
    assert train.count() + test.count() == 200


def test_own_splitter_and_saved_run(spark, classes, tmp_path):
    seen = []

    def splitter(table, repeat, fold, seed):
        seen.append((repeat, fold, seed))
        return table.withColumn("part", F.when(F.col("row_id") % 4 == fold, "test").otherwise("train"))

    exp = Experiment("d", model="linear", methods=("random_fs", "magic"), num_features=10, num_repeats=1, num_folds=2, num_k_folds=2, splitter=splitter)
    found, _ = experiment.run(classes, exp)
    assert seen == [(0, 0, 44), (0, 1, 45)] and found.count() == 2
    summary = experiment.save_run(found, exp, str(tmp_path), datetime(2024, 5, 6, 7, 8, 9)).collect()
    assert [(r["method"], r["metric"]) for r in summary] == [("random_fs", "log_loss")]
    configs = {r["run_id"]: json.loads(r["config"]) for r in result_files.read_configs(spark, f"{tmp_path}/configs").collect()}
    assert set(configs) == {f"d_{m}_num_features_10_20240506_070809" for m in ("random_fs", "magic")}
    assert configs["d_random_fs_num_features_10_20240506_070809"]["avg_fold_time"] > 0
    assert configs["d_magic_num_features_10_20240506_070809"]["total_elapsed_time"] is None
    assert spark.read.parquet(f"{tmp_path}/results").count() == 2


def test_fitted_reducer_is_not_fitted_again(spark, classes):
    model = make_reducer("random_fs", num_features=5, seed=1).fit(classes)
    bagged = bag(classes, make_learner("linear", task_type="multiclass", classes=3), model, folds=2)
    assert all(r is model for r, _ in bagged.folds) and bagged.refit[0] is model


def test_unknown_scope(classes):
    with pytest.raises(ValueError, match="scope"):
        experiment.run(classes, Experiment("d", scope="galaxy"))


def test_grid(spark):
    names = spark.createDataFrame([("hiva",), ("12",), ("csv:/x/y.csv",)], "dataset string")
    rows = experiment.grid(names, ["a", "b"], ["m"], {"hiva": "363677"}).collect()
    assert len(rows) == 6 and {r["source"] for r in rows} == {"task:363677", "task:12", "csv_path:/x/y.csv"}
    with pytest.raises(Exception, match="unknown dataset alias nope"):
        experiment.grid(spark.createDataFrame([("nope",)], "dataset string"), ["a"], ["m"], {"hiva": "1"}).collect()
