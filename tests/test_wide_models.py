"""Block Lanczos, pivoted kernel landmarks, L1 folds and two-level block sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.operators import lasso, matrix, reduce
from widetab.operators.base import ReducerModel
from widetab.operators.registry import make_reducer


@pytest.mark.parametrize("k,decay", [(3, 0.8), (10, 0.97), (25, 1.0)])
def test_block_lanczos_equals_eigenvectors(spark, k, decay):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(80, 120)) * decay ** np.arange(120)
    axes, means, values, total = reduce.principal_axes(frame(spark, x), k, gram_limit=10)
    cov = np.cov(x.T)
    expected = np.linalg.eigvalsh(cov)[::-1][:k]
    assert np.allclose(values, expected, rtol=1e-6) and np.isclose(total, np.trace(cov)) and np.allclose(means, x.mean(axis=0))
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-8)
    assert (np.linalg.norm(cov @ axes - axes * values, axis=0) <= 1.01 * reduce.RESIDUAL * values[0]).all()


def test_block_lanczos_on_few_ranks(spark):
    """More directions than the rows span, and several equal variances."""
    x = np.zeros((12, 40))
    x[np.arange(12), np.arange(12)] = 2.0
    axes, _, values, _ = reduce.principal_axes(frame(spark, x), 12, gram_limit=10)
    expected = np.linalg.eigvalsh(np.cov(x.T))[::-1][:12]
    assert np.allclose(values, expected, atol=1e-9) and np.allclose(axes.T @ axes, np.eye(12), atol=1e-8)


def test_block_lanczos_says_when_it_does_not_converge(spark):
    x = np.random.default_rng(22).normal(size=(60, 90))
    df = frame(spark, x)
    with pytest.raises(ValueError, match="passes leave residuals"):
        reduce.block_lanczos(df, 90, 60, x.mean(axis=0), 5, 0, max_passes=1)


def pivots(kernel, keys, count):
    """Greedy pivots of the Cholesky factor, equal residuals by key."""
    n = len(kernel)
    factor, chosen = np.zeros((n, 0)), []
    for _ in range(count):
        rest = np.round(1 - (factor**2).sum(axis=1), 12)
        best = min(range(n), key=lambda i: (-rest[i], keys[i]))
        chosen.append(best)
        factor = np.column_stack([factor, (kernel[:, best] - factor @ factor[best]) / np.sqrt(rest[best])])
    return chosen, factor


@pytest.mark.parametrize("candidates", [4, 64])
def test_landmarks_are_the_pivots(spark, candidates):
    from widetab.functions.rng import hash52

    x = np.random.default_rng(23).normal(size=(50, 3))
    df = frame(spark, x)
    keys = [r["k"] for r in df.select("row_id", hash52(0, F.col("row_id")).alias("k")).orderBy("row_id").collect()]
    chosen, factor = pivots(matrix.kernel_rows(x, x, 0.2), keys, 12)
    marks, residual = reduce.kernel_landmarks(df, 0.2, 1.0, limit=12, slack=1.0, candidates=candidates)
    assert marks.ids == chosen
    assert np.allclose(marks.coordinates(x), factor, atol=1e-7)
    left = (1 - (factor**2).sum(axis=1)).sum()
    spanned = ((factor - factor.mean(axis=0)) ** 2).sum()
    assert np.isclose(residual, left / (left + spanned), atol=1e-8)


def test_share_of_the_kernel(spark):
    x = np.random.default_rng(24).normal(size=(80, 4))
    df = frame(spark, x)
    sizes = []
    for share in (0.5, 0.9, 0.999):
        model = make_reducer("kpca_dr", num_features=2, kernel_share=share).fit(df)
        assert model.residual <= 1 - share
        sizes.append(len(model.landmarks))
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]
    kernel = matrix.kernel_rows(x, x, 0.25)
    centred = kernel - kernel.mean(axis=0) - kernel.mean(axis=1)[:, None] + kernel.mean()
    expected = np.linalg.eigvalsh(centred)[::-1][:2] / 79
    assert np.allclose(model.variance, expected, rtol=0.01)
    exact = make_reducer("kpca_dr", num_features=2, kernel_share=1.0).fit(df)
    assert np.allclose(exact.variance, expected, rtol=1e-6) and exact.residual < 1e-8


def test_kernel_components_must_exist(spark, tmp_path):
    x = np.repeat(np.random.default_rng(25).normal(size=(5, 3)), 6, axis=0)
    df = frame(spark, x)
    model = make_reducer("kpca_dr", num_features=4, kernel_share=1.0).fit(df)
    assert len(model.landmarks) == 5
    for k in (5, 6, 30):
        with pytest.raises(ValueError, match="cannot compute"):
            make_reducer("kpca_dr", num_features=k).fit(df)
    model.save(str(tmp_path / "m"))
    again = ReducerModel.load(str(tmp_path / "m"))
    assert again.residual == model.residual and np.allclose(to_numpy(again.transform(df)), to_numpy(model.transform(df)))


@pytest.mark.parametrize("alpha", [None, 0.05, 1e6])
def test_l1_of_all_folds(spark, planted, alpha):
    x, score, signal = planted
    x = x.copy()
    x[:, 7] = 4.0
    x[:, 8] = x[:, 3] + 0.05 * x[:, 8]
    df = frame(spark, x, score).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    found = lasso.fold_coefficients(df, 3, alpha=alpha)
    for f in range(3):
        own, target = x[np.arange(200) % 3 != f], score[np.arange(200) % 3 != f]
        z = (own - own.mean(axis=0)) / np.where(own.std(axis=0) > 0, own.std(axis=0), 1)
        penalty = 0.1 * np.abs(z.T @ (target - target.mean()) / len(own)).max() if alpha is None else alpha
        slopes = z.T @ (target - target.mean() - z @ found[f]) / len(own)  # optimal exactly when these are within the penalty
        used = found[f] != 0
        assert np.allclose(slopes[used], penalty * np.sign(found[f][used]), atol=1e-7) and (np.abs(slopes[~used]) <= penalty + 1e-7).all()
        assert found[f][7] == 0 and used.any() == (alpha != 1e6)
    models = make_reducer("lasso_fs", num_features=4, task_type="regression", alpha=alpha).fit_folds(df, 3)
    if alpha is None:
        assert all({11, 17, 25} <= set(m.indices) for m in models.values())


def test_sums_in_two_steps(spark):
    """No task receives more than about the root of all partial sums."""
    n = 400
    partials = spark.range(n).repartition(n).selectExpr("0 bi", "cast(id % 2 as int) bj", "1 n_rows", "2 n_cols", "array(cast(id as double), 1d) cells")
    rows = {r["bj"]: list(r["cells"]) for r in matrix.add_blocks(partials).collect()}
    assert rows == {0: [sum(range(0, n, 2)), n / 2], 1: [sum(range(1, n, 2)), n / 2]}
    assert matrix.add_rows(partials.select("cells")).tolist() == [sum(range(n)), n]
