"""Units, seeds, stages and sharing of experiments; configuration search in document order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame
from widetab.operators.learn import fit_alone, make_learner
from widetab.operators.registry import make_reducer
from widetab.plans import experiment
from widetab.plans.experiment import Experiment
from widetab.sources import results


@pytest.fixture
def table(spark, planted):
    x, score, _ = planted
    wide = frame(spark, x, (score > 0).astype(int))
    return wide.select("row_id", "label", *[F.get("features", F.lit(i)).alias(f"c{i}") for i in range(6)])


def test_units_come_from_the_published_splits(spark, table):
    splits = table.select("row_id", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("u")).select(
        "row_id", (F.col("u") / 2).cast("int").alias("repeat"), (F.col("u") % 2).alias("fold"), F.when((F.col("row_id") + F.col("u")) % 3 == 0, "test").otherwise("train").alias("part"))
    exp = Experiment("d", model="linear", methods=("original",), scope="split", bagging=False)
    assert len(experiment.units(exp, table, splits)) == 6 and len(experiment.units(exp, table)) == 30
    assert len(experiment.units(Experiment("d", num_repeats=1), table, splits)) == 2
    assert experiment.units(Experiment("d", dry_run=True, num_repeats=7), table, splits) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    found, errors = experiment.run(table, exp, splits)
    assert found.count() == 6 and errors.count() == 0


def test_without_bagging(spark, table, planted):
    x, score, _ = planted
    exp = Experiment("d", model="linear", methods=("random_fs",), num_features=3, num_repeats=1, num_folds=1, bagging=False)
    found, errors = experiment.run(table, exp)
    rows = found.collect()
    assert errors.count() == 0 and len(rows) == 1 and rows[0]["val_score"] is None and rows[0]["score"] > 0.5
    alone = fit_alone(frame(spark, x, score), make_learner("linear", task_type="regression"), make_reducer("kbest_fs", num_features=4, task_type="regression"), "regression")
    assert alone.oof is None and alone.val_scores == {} and alone.score(frame(spark, x, score))["rmse"] < np.std(score)
    alone.release()


def test_seeds_by_scope(spark, table, monkeypatch):
    seen = []
    monkeypatch.setattr(experiment, "make_reducer", lambda method, **kw: seen.append(kw["seed"]) or make_reducer(method, **kw))
    for scope, mode in (("split", "scope"), ("fold", "scope"), ("split", "base"), ("fold", "repeat")):
        exp = Experiment("d", model="linear", methods=("random_fs",), num_features=2, num_repeats=2, num_folds=1, num_k_folds=2, scope=scope, reducer_seed=mode, seed=5)
        assert experiment.run(table, exp)[1].count() == 0
    assert seen == [5, 105, 5, 5, 5, 5, 5, 105]
    with pytest.raises(ValueError, match="reducer_seed"):
        experiment.run(table, Experiment("d", reducer_seed="other"))


def test_a_sweep_prepares_every_split_once(spark, table, monkeypatch):
    calls = []
    monkeypatch.setattr(experiment, "prepare", lambda *a, prepare=experiment.prepare, **kw: calls.append(1) or prepare(*a, **kw))
    exp = Experiment("d", model="linear", methods=("random_fs",), num_repeats=1, num_folds=2, scope="split", bagging=False)
    found, errors = experiment.width_sweep(table, exp, (2, 4, 99))
    assert len(calls) == 2
    assert sorted((r["num_features"], r["fold"]) for r in found.collect()) == [(2, 0), (2, 1), (4, 0), (4, 1)]
    failed = errors.collect()
    assert {(r["num_features"], r["stage"]) for r in failed} == {(99, "reduce")} and len(failed) == 2


def test_stage_of_a_failure(spark, table, monkeypatch):
    exp = Experiment("d", model="oracle", methods=("random_fs",), num_features=2, num_repeats=1, num_folds=1, num_k_folds=2)
    assert experiment.run(table, exp)[1].first()["stage"] == "reduce"
    monkeypatch.setattr(experiment, "bag", lambda *a, **kw: 1 / 0)
    assert experiment.run(table, Experiment("d", model="linear", num_features=2, num_repeats=1, num_folds=1))[1].first()["stage"] == "fit"
    broken = Experiment("d", splitter=lambda *a: 1 / 0, num_repeats=1, num_folds=1)
    assert experiment.run(table, broken)[1].first()["stage"] == "prepare"


def depth_first(node, key):
    if key in node:
        return node[key]
    for child in node.values():
        if isinstance(child, dict) and (hit := depth_first(child, key)) is not None:
            return hit
    return None


CONFIGS = {
    "own entry before children": {"x": {"k": 1}, "k": 2},
    "first child first": {"a": {"b": {"c": {"k": 1}}}, "d": {"k": 2}},
    "child's own entry before its children": {"x": {"deep": {"k": 1}, "k": 2}, "y": {"k": 3}},
    "siblings of equal depth": {"x": {"n": 0, "m": {"k": 1}}, "y": {"m": {"k": 2}}},
    "only deep": {"x": {"n": 0}, "y": {"z": {"k": 9}}},
}


def lines_of(node, depth=0):
    for key, value in node.items():
        if isinstance(value, dict):
            yield "  " * depth + f"{key}:"
            yield "# a comment"
            yield from lines_of(value, depth + 1)
        else:
            yield "  " * depth + f"{key}: {value}"
            yield ""


@pytest.mark.parametrize("name", CONFIGS)
def test_config_search_in_document_order(spark, tmp_path, name):
    (tmp_path / "run_config.yaml").write_text("\n".join(lines_of(CONFIGS[name])))
    found = results.config_value(results.read_config_files(spark, str(tmp_path)), "k").collect()
    assert [r["value"] for r in found] == [str(depth_first(CONFIGS[name], "k"))]
