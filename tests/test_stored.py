"""Fitted stages and bagged models written, read again in another session, and applied to new rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.operators import encode, split
from widetab.operators.boosting import HistogramBoosting
from widetab.operators.learn import bag, fit_alone, make_learner
from widetab.operators.registry import make_reducer
from widetab.plans import stored
from widetab.plans.prepare import prepare


def mixed_table(spark):
    rng = np.random.default_rng(41)
    rows = [(i, "yes" if (i * 7) % 3 else "no", float(rng.normal()) if i % 9 else None, f"c{i % 4}" if i % 5 else None, f"k{i % 300}", bool(i % 2)) for i in range(600)]
    return spark.createDataFrame(rows, "row_id bigint, label string, x double, short string, long string, flag boolean").withColumn("day", F.date_add(F.lit("2020-01-01"), (F.col("row_id") % 50).cast("int")))


def test_stages_of_a_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(encode, "LITERAL_CODES", 50)
    table = split.holdout(mixed_table(spark), 0.3, 1, "label")
    train, test = (table.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    prepared = prepare(train, test, "binary", reducer=make_reducer("kbest_fs", num_features=4, task_type="binary"))
    stored.save(prepared.fitted, str(tmp_path / "stages"))
    other = spark.newSession()
    again = stored.load(other, str(tmp_path / "stages"))
    assert again.names == prepared.names and len(again.stages) == len(prepared.fitted.stages)
    rows = sorted(map(tuple, prepared.test.select("row_id", "label", "features").collect()))
    assert sorted(map(tuple, again.transform(test).select("row_id", "label", "features").collect())) == rows
    labels = [s for s in again.stages if type(s).__name__ == "LabelCoderModel"]
    assert labels[0].classes == ["no", "yes"]


@pytest.mark.parametrize("learner,task", [("gbt", "multiclass"), ("linear", "regression"), ("forest", "binary")])
def test_bagged_models(spark, planted, tmp_path, learner, task):
    x, score, _ = planted
    y = score if task == "regression" else np.digitize(score, [-1, 1]) if task == "multiclass" else (score > 0).astype(int)
    df = frame(spark, x, y)
    small = {"gbt": dict(maxIter=2, maxDepth=2), "linear": {}, "forest": dict(numTrees=3)}[learner]
    model = make_learner(learner, task_type=task, classes=3 if task == "multiclass" else 2, **small)
    column = "prediction" if task == "regression" else "probability"
    for name, fitted in (
        ("refit", bag(df, model, make_reducer("kbest_fs", num_features=5, task_type=task), folds=2, task_type=task)),
        ("mean", bag(df, model, make_reducer("pca_dr", num_features=3), folds=2, task_type=task, mode="mean")),
        ("alone", fit_alone(df, model, None, task)),
    ):
        stored.save(fitted, str(tmp_path / name))
        again = stored.load(spark.newSession(), str(tmp_path / name))
        assert np.allclose(to_numpy(again.predict(df), column), to_numpy(fitted.predict(df), column))
        assert again.val_scores == fitted.val_scores and (again.oof is None) == (fitted.oof is None)
        if again.oof is not None:
            assert again.oof.count() == len(x)


def test_boosting_on_categories_and_typed_classes(spark, tmp_path):
    rng = np.random.default_rng(42)
    x = np.column_stack([rng.integers(0, 9, 200), rng.normal(size=200)]).astype(float)
    df = frame(spark, x, (x[:, 0] > 4).astype(int))
    model = HistogramBoosting("binary", 2, maxIter=2, maxDepth=2, categories=[0]).fit(df)
    stored.save(model, str(tmp_path / "trees"))
    again = stored.load(spark.newSession(), str(tmp_path / "trees"))
    assert np.allclose(to_numpy(again.predict(df), "probability"), to_numpy(model.predict(df), "probability"))
    days = spark.sql("select date'2020-02-01' label union all select date'2019-01-01'")
    coder = encode.LabelCoder().fit(days)
    stored.save(coder, str(tmp_path / "coder"))
    assert stored.load(spark, str(tmp_path / "coder")).classes == coder.classes
    with pytest.raises(ValueError, match="cannot be stored"):
        stored.save(object(), str(tmp_path / "nothing"))
