import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.operators import gate, select
from widetab.operators.registry import make_reducer


def test_random_selection_is_seeded_and_keeps_sampled_order(spark, planted):
    df = frame(spark, planted[0])
    a = make_reducer("random_fs", num_features=10, seed=1).fit(df)
    b = make_reducer("random_fs", num_features=10, seed=1).fit(df.repartition(3))
    c = make_reducer("random_fs", num_features=10, seed=2).fit(df)
    assert a.indices == b.indices != c.indices and len(set(a.indices)) == 10 and a.indices != sorted(a.indices)
    assert np.array_equal(to_numpy(a.transform(df)), planted[0][:, a.indices])


def test_variance_cut_is_strict_and_population(spark):
    x = np.array([[0.0, 0.0, 3.0], [1.0, 0.0, 3.0], [0.0, 1.0, 3.0], [1.0, 0.0, 3.0]])
    fit = lambda t: make_reducer("variance_fs", var_threshold=t).fit(frame(spark, x)).indices
    assert fit(0.75) == [0]  # 0.25 > 0.1875, but 0.1875 is not above itself
    assert fit(0.5 + 1e-4) == [0] and fit(0.9) == [0, 1]
    with pytest.raises(ValueError, match="variance"):
        fit(0.5)


@pytest.mark.parametrize("method", ["kbest_fs", "lasso_fs", "tabpfn_fs", "tree_fs"])
@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
def test_planted_columns_are_found(spark, planted, method, task):
    x, score, signal = planted
    y = {"binary": (score > 0).astype(int), "regression": score, "multiclass": np.digitize(score, [-1, 1])}[task]
    model = make_reducer(method, num_features=4, task_type=task, seed=1).fit(frame(spark, x, y))
    if method == "tree_fs":
        assert set(signal) <= set(model.indices) and len(model.indices) < 20
    else:
        assert set(model.indices) == set(signal)
    if method in ("kbest_fs", "lasso_fs", "tree_fs"):
        assert model.indices == sorted(model.indices)
    report = model.report.collect()
    assert len(report) == 30 and {r["feature_idx"] for r in report if r["selected"]} == set(model.indices)


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_gate_finds_planted_columns(spark, planted, task):
    x, score, signal = planted
    y = score if task == "regression" else (score > 0).astype(int)
    estimator = make_reducer("sand_fs", num_features=4, task_type=task, epochs=60, seed=1)
    model = estimator.fit(frame(spark, x, y))
    assert set(model.indices) == set(signal)
    assert estimator.losses[-1] < estimator.losses[0]
    weights = {r["feature_idx"]: r["score"] for r in model.report.collect()}
    assert [weights[i] for i in model.indices] == sorted((weights[i] for i in model.indices), reverse=True)


def test_gate_does_not_depend_on_partitioning(spark, planted):
    x, score, _ = planted
    fit = lambda df: {r["feature_idx"]: r["score"] for r in make_reducer("sand_fs", num_features=4, task_type="regression", epochs=3).fit(df).report.collect()}
    a, b = fit(frame(spark, x, score)), fit(frame(spark, x, score).repartition(2))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_gate_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    w, target, k = rng.uniform(0.1, 0.9, 6), rng.normal(size=6), 3
    loss = lambda v: ((gate.projected(v, k) - target) ** 2).sum()
    found = gate.projection_gradient(w, k, 2 * (gate.projected(w, k) - target))
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-6
        assert np.isclose(found[i], (loss(w + step) - loss(w - step)) / 2e-6, rtol=1e-4)


def coordinate_descent(z, y, alpha, rounds=2000):
    beta, residual = np.zeros(z.shape[1]), y - y.mean()
    for _ in range(rounds):
        for j in range(z.shape[1]):
            rho = (z[:, j] * (residual + z[:, j] * beta[j])).mean()
            new = np.sign(rho) * max(abs(rho) - alpha, 0) / (z[:, j] ** 2).mean()
            residual += z[:, j] * (beta[j] - new)
            beta[j] = new
    return beta


def test_lasso_coefficients_equal_coordinate_descent(spark, planted):
    x, score, _ = planted
    y = score + np.random.default_rng(3).normal(size=200)
    z = (x - x.mean(0)) / x.std(0)
    alpha = 0.1 * np.abs(z.T @ (y - y.mean())).max() / len(y)
    estimator = make_reducer("lasso_fs", num_features=30, task_type="regression", tol=1e-9)
    found = {r["feature_idx"]: r["score"] for r in estimator.fit(frame(spark, x, y)).report.collect()}
    expected = np.abs(coordinate_descent(z, y, alpha))
    assert np.allclose([found[i] for i in range(30)], expected, atol=1e-4)
    strict = make_reducer("lasso_fs", num_features=30, task_type="regression", tol=1e-9, strict=True).fit(frame(spark, x, y))
    assert strict.indices == [i for i in range(30) if found[i] > 0] and len(strict.indices) < 30


def test_logistic_lasso_satisfies_its_optimality_conditions(spark, planted):
    x, score, _ = planted
    y = (score > 0).astype(int)
    z = (x - x.mean(0)) / x.std(0)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = frame(spark, z, y).select(array_to_vector("features").alias("v"), F.col("label").cast("double").alias("y"))
    model = LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=1 / 200, standardization=False, tol=1e-9, maxIter=3000).fit(rows)
    beta = model.coefficients.toArray()
    gradient = z.T @ (1 / (1 + np.exp(-(z @ beta + model.intercept))) - y)
    assert np.all(np.abs(gradient) <= 1 + 1e-2)
    assert np.allclose(gradient[beta != 0], -np.sign(beta[beta != 0]), atol=1e-2)
    found = make_reducer("lasso_fs", num_features=5, task_type="binary", tol=1e-9).fit(frame(spark, x, y))
    assert found.indices == sorted(np.argsort(-np.abs(beta), kind="stable")[:5])


def test_fold_models_equal_single_fits(spark, planted):
    x, score, _ = planted
    df = frame(spark, x, np.digitize(score, [-1, 1])).withColumn("fold", F.pmod("row_id", F.lit(3)).cast("int")).persist()
    for estimator in (make_reducer("kbest_fs", num_features=6), make_reducer("variance_fs", var_threshold=0.01)):
        together = estimator.fit_folds(df, 3)
        for i in range(3):
            assert together[i].indices == estimator.fit(df.filter(F.col("fold") != i)).indices


def test_selection_does_not_depend_on_row_order(spark, planted):
    x, score, _ = planted
    y = (score > 0).astype(int)
    order = np.random.default_rng(5).permutation(len(x))
    pick = lambda df: make_reducer("kbest_fs", num_features=7, task_type="binary").fit(df).indices
    assert pick(frame(spark, x, y)) == pick(frame(spark, x[order], y[order], ids=order))


def test_ensemble_without_views_uses_all_rows(spark):
    """Rows ordered by class: only the last fifth tells that feature 2 matters."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 4)), np.repeat(np.arange(5), 40)
    x[y == 4, 2] += 10
    for views in (0, 1):
        assert make_reducer("tabpfn_fs", num_features=1, num_ensemble=views, task_type="multiclass").fit(frame(spark, x, y)).indices == [2]


def test_view_scores_leave_one_part_out(spark, planted):
    x, score, _ = planted
    df = frame(spark, x, (score > 0).astype(int))
    from widetab.functions.rng import hash52
    from widetab.operators.stats import anova_scores

    views = select.view_scores(df, 3, 9)
    kept = df.filter(F.pmod(hash52(9, F.col("row_id")), F.lit(3)) != 1)
    direct = {r["feature_idx"]: r["score"] for r in anova_scores(kept).collect()}
    for r in views.filter("view_id = 1").collect():
        assert np.isclose(r["score"], direct[r["feature_idx"]])
