"""Boosted and extremely randomised trees against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.functions.rng import hash52, mix64, stream, unit
from widetab.operators import boosting, extra_trees
from widetab.operators.boosting import UNIT, HistogramBoosting, slopes, softmax
from widetab.operators.learn import bag, make_learner
from widetab.operators.registry import make_reducer
from widetab.operators.target import TargetEncoder


def interaction(rng, n, noise=6):
    """Three classes that no single feature tells apart."""
    x = rng.normal(size=(n, 3 + noise))
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int) + ((x[:, 2] > 0.3) & (x[:, 0] > 0)).astype(int)


# boosting

def brute_tree(table, g, h, bins, depth, penalty):
    """``{path: (feature, bin)}`` of one tree grown on integer gradients, all splits tried."""
    classes = g.shape[1]
    value = lambda rows: (((g[rows].sum(0) / UNIT) ** 2) / (h[rows].sum(0) / UNIT + penalty)).sum()
    found, open_ = {}, [("", np.arange(len(table)))]
    while open_:
        path, rows = open_.pop()
        if len(path) == depth:
            continue
        best = (0.0, None)
        for f in range(table.shape[1]):
            for b in range(bins - 1):
                left, right = rows[table[rows, f] <= b], rows[table[rows, f] > b]
                if len(left) and len(right):
                    gain = value(left) + value(right) - value(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
        if best[1]:
            f, b = found[path] = best[1]
            open_ += [(path + "l", rows[table[rows, f] <= b]), (path + "r", rows[table[rows, f] > b])]
    return found


def paths(tree):
    found, open_ = {}, [("", 0)]
    while open_:
        path, node = open_.pop()
        if tree.feature[node] >= 0:
            found[path] = (int(tree.feature[node]), int(tree.bin[node]))
            open_ += [(path + "l", int(tree.left[node])), (path + "r", int(tree.left[node]) + 1)]
    return found


def bins_of(model, x):
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(model.cuts)], axis=1)


@pytest.mark.parametrize("task", ["multiclass", "regression"])
def test_first_tree_equals_full_search(spark, task, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 60)  # several blocks of features
    monkeypatch.setattr(boosting, "PASS_CELLS", 200)  # and several scans a level
    x, y = interaction(np.random.default_rng(3), 300, noise=2)
    y = x[:, 0] * x[:, 1] + y if task == "regression" else y
    learner = HistogramBoosting(task, 3, maxIter=1, maxDepth=3, maxBins=6, validation=0.0)
    model = learner.fit(frame(spark, x, y))
    target = (y - model.centre) / model.scale if task == "regression" else y
    g, h = slopes(np.broadcast_to(model.base, (len(x), len(model.base))), target)
    assert paths(model.trees[0]) == brute_tree(bins_of(model, x), g, h, 6, 3, learner.penalty)
    leaf = model.trees[0].nodes(bins_of(model, x))
    for node in np.unique(leaf):
        rows = leaf == node
        expected = -learner.rate * g[rows].sum(0) / (h[rows].sum(0) + learner.penalty * UNIT)
        assert np.allclose(model.trees[0].value[node], expected)


def test_trees_do_not_depend_on_partitions(spark):
    x, y = interaction(np.random.default_rng(4), 400)
    df = frame(spark, x, y)
    models = [HistogramBoosting("multiclass", 3, maxIter=18, maxDepth=3).fit(df.repartition(p)) for p in (1, 7)]  # over a refresh of the margins
    assert len(models[0].trees) == len(models[1].trees) > boosting.REFRESH
    assert (models[0].scores(x) == models[1].scores(x)).all()


def test_interaction_and_validation(spark):
    rng = np.random.default_rng(5)
    x, y = interaction(rng, 1500)
    learner = HistogramBoosting("multiclass", 3, maxDepth=3)
    model = learner.fit(frame(spark, x, y))
    fresh, truth = interaction(rng, 500)
    p = model.scores(fresh)
    assert (p.argmax(axis=1) == truth).mean() > 0.93 and np.allclose(p.sum(axis=1), 1)
    noise = learner.fit(frame(spark, x, rng.integers(0, 3, len(x))))
    assert len(noise.trees) < len(model.trees) < 100


def test_models_of_all_folds_from_the_same_scans(spark):
    x, y = interaction(np.random.default_rng(6), 300, noise=1)
    df = frame(spark, x, y)
    folded = df.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    learner = HistogramBoosting("multiclass", 3, maxIter=4, maxDepth=3, validation=0.2)
    models = learner.fit_folds(folded, 3)
    alone = learner.fit(df)
    assert len(models) == 4 and (models[3].scores(x) == alone.scores(x)).all()
    changed = folded.withColumn("label", F.when(F.col("fold") == 1, (F.col("label") + 1) % 3).otherwise(F.col("label")).cast("int"))
    again = learner.fit_folds(changed, 3)
    assert (models[1].scores(x) == again[1].scores(x)).all() and not (models[0].scores(x) == again[0].scores(x)).all()


def test_bagging_uses_one_fit_for_all_folds(spark):
    x, y = interaction(np.random.default_rng(7), 600, noise=1)
    bagged = bag(frame(spark, x, y), make_learner("gbt", task_type="multiclass", classes=3, maxIter=15, maxDepth=3), folds=3)
    rows = bagged.oof.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(600))
    assert bagged.val_scores["log_loss"] < 0.6 and bagged.score(frame(spark, x, y))["log_loss"] < bagged.val_scores["log_loss"]


def test_models_that_see_a_choice_of_features(spark):
    x, y = interaction(np.random.default_rng(14), 240, noise=2)
    df = frame(spark, x, y).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    learner = HistogramBoosting("multiclass", 3, maxIter=3, maxDepth=3)
    choices = [[4, 0, 1], [3, 2], [0, 1, 2, 3]]
    models = learner.fit_folds(df, 2, selections=choices)
    whole = learner.fit(frame(spark, x[:, choices[2]], y))
    assert (models[2].scores(x[:, choices[2]]) == whole.scores(x[:, choices[2]])).all()
    assert all(len(m.cuts) == len(c) and set(m.used_features()) <= set(range(len(c))) for m, c in zip(models, choices))
    bagged = bag(df.drop("fold"), learner, make_reducer("kbest_fs", num_features=3), folds=2)
    assert sorted(r["row_id"] for r in bagged.oof.collect()) == list(range(240)) and len(bagged.score(df.drop("fold"))) > 0


def test_boosting_edge_cases(spark):
    x, y = interaction(np.random.default_rng(8), 60, noise=0)
    x[:, 1] = 2.5
    constant = HistogramBoosting("regression").fit(frame(spark, x, np.full(60, 7.0)))
    assert not constant.trees and np.allclose(constant.scores(x), 7)
    one = HistogramBoosting("binary", 2, maxIter=3).fit(frame(spark, x, np.zeros(60, int)))
    assert (one.scores(x).argmax(axis=1) == 0).all()
    assert 1 not in HistogramBoosting("multiclass", 3, maxIter=5).fit(frame(spark, x, y)).used_features()
    with pytest.raises(ValueError, match="not a class"):
        HistogramBoosting("multiclass", 2).fit(frame(spark, x, y + 1))
    with pytest.raises(ValueError, match="no rows"):
        HistogramBoosting("regression").fit(frame(spark, x, x[:, 0]).limit(0))
    assert np.allclose(softmax(np.array([[1000.0, 1000.0]])), 0.5)


@pytest.mark.parametrize("rows_per_bucket", [16, 4096])
@pytest.mark.parametrize("task", ["multiclass", "regression"])
def test_ordered_target_statistics(spark, rows_per_bucket, task):
    rng = np.random.default_rng(12)
    n = 200
    x = np.column_stack([rng.normal(size=n), np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 30, n)), rng.integers(0, 3, n)])
    x[5, 2] = np.nan
    y = rng.integers(0, 3, n) if task == "multiclass" else rng.normal(size=n)
    df = frame(spark, x, y)
    statistics = TargetEncoder([1, 2], task, 3, seed=4).fit(df)
    order = [r[0] for r in df.select("row_id", hash52(4, F.col("row_id")).alias("k")).orderBy("k", "row_id").collect()]
    wanted = [(y == c).astype(float) for c in range(3)] if task == "multiclass" else [y]
    code = lambda i, f: None if np.isnan(x[i, f]) else x[i, f]

    def mean(rows):
        return [(sum(w[j] for j in rows) + w.mean()) / (len(rows) + 1) for w in wanted]

    trained = dict(zip(range(n), to_numpy(statistics.transform_training(df, rows_per_bucket))))
    applied = dict(zip(range(n), to_numpy(statistics.transform(df))))
    for place, i in enumerate(order):
        for out, rows in ((trained, order[:place]), (applied, order)):
            same = [[j for j in rows if code(j, f) == code(i, f)] for f in (1, 2)]
            assert np.allclose(out[i], [x[i, 0], *mean(same[0]), *mean(same[1])])
    unseen = to_numpy(statistics.transform(frame(spark, np.array([[1.0, 99.0, 99.0]]))))
    assert np.allclose(unseen, [[1.0, *[w.mean() for w in wanted], *[w.mean() for w in wanted]]])


def test_boosting_on_categories(spark):
    """Codes without an order: the statistics tell the classes apart, and do not leak the label of the row itself."""
    rng = np.random.default_rng(13)
    code = rng.integers(0, 40, 800)
    x = np.column_stack([code, rng.normal(size=800), np.arange(800)]).astype(float)
    y = ((code * 7919) % 40 < 20).astype(int)
    learner = make_learner("gbt", task_type="binary", classes=2, maxIter=10, maxDepth=2, categories=[0, 2])
    df = frame(spark, x, y)
    model = learner.fit(df)
    fresh = x.copy()
    fresh[:, 2] += 1000
    out = model.predict(frame(spark, fresh, y)).collect()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.97 and len(out[0]["features"]) == 3


# extremely randomised trees

def brute_importances(x, y, trees, seed, wanted, max_depth=None):
    """The same hashes, every node by plain recursion, impurities by their definitions."""
    classes = None if y.dtype.kind == "f" else sorted(set(y))

    def impurity(rows):
        if classes is None:
            return y[rows].var()
        return 1 - sum(np.mean(y[rows] == c) ** 2 for c in classes)

    def visit(rows, key, depth, out):
        if len(rows) < 2 or len(set(y[rows])) == 1 or depth == max_depth:
            return
        low, high = x[rows].min(0), x[rows].max(0)
        order = stream(np.uint64(key), np.arange(x.shape[1]))
        best = None
        for f in [f for f in np.argsort(order, kind="stable") if high[f] > low[f]][:wanted]:
            cut = low[f] + unit(mix64(order[f])) * (high[f] - low[f])
            left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
            gain = len(rows) * impurity(rows) - len(left) * impurity(left) - len(right) * impurity(right)
            per_row = round(gain / len(rows) / (1 if classes else np.ptp(y) ** 2), 12)
            if best is None or per_row > best[0]:
                best = per_row, f, left, right, gain
        if best is None:
            return
        out[best[1]] += best[4]
        visit(best[2], extra_trees.child_key(key, 0), depth + 1, out)
        visit(best[3], extra_trees.child_key(key, 1), depth + 1, out)

    total = np.zeros(x.shape[1])
    for t in range(trees):
        out = np.zeros(x.shape[1])
        visit(np.arange(len(x)), extra_trees.root_key(seed, t), 0, out)
        total += out / max(out.sum(), 1e-300)
    return total / total.sum()


def found_importances(df, **params):
    return np.array([r["score"] for r in extra_trees.importances(df, **params).orderBy("feature_idx").collect()])


@pytest.mark.parametrize("local_rows", [2, 30, 10**6])
@pytest.mark.parametrize("regression", [False, True])
def test_importances_equal_recursion(spark, local_rows, regression):
    x, y = interaction(np.random.default_rng(9), 150, noise=4)
    x[:, 4] = 1.0
    x[:, 5] = np.round(x[:, 5])
    y = x[:, 0] + 0.5 * x[:, 1] if regression else y
    wanted = x.shape[1] if regression else math.isqrt(x.shape[1])
    expected = brute_importances(x, y, 3, 11, wanted)
    found = found_importances(frame(spark, x, y), trees=3, seed=11, regression=regression, local_rows=local_rows)
    assert np.allclose(found, expected, atol=1e-6) and found[4] == 0


def test_importances_to_a_depth(spark):
    x, y = interaction(np.random.default_rng(10), 200)
    for local_rows in (20, 10**6):
        found = found_importances(frame(spark, x, y), trees=2, seed=5, max_depth=2, local_rows=local_rows)
        assert np.allclose(found, brute_importances(x, y, 2, 5, 3, max_depth=2), atol=1e-9)


def test_importances_find_the_signal(spark, planted):
    x, score, signal = planted
    found = found_importances(frame(spark, x, (score > 0).astype(int)), trees=20, seed=1)
    assert set(np.argsort(-found)[:4]) == set(signal)


def test_importances_edge_cases(spark):
    x = np.ones((20, 3))
    assert (found_importances(frame(spark, x, np.arange(20) % 2)) == 0).all()
    assert (found_importances(frame(spark, x + np.arange(20)[:, None], np.zeros(20, int))) == 0).all()
    with pytest.raises(ValueError, match="no rows"):
        extra_trees.importances(frame(spark, x).limit(0).withColumn("label", F.lit(1)))
