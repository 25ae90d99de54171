import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.operators import matrix, reduce, ward
from widetab.operators.base import ReducerModel
from widetab.operators.registry import REDUCERS, make_reducer


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks and several passes already at 20 columns."""
    monkeypatch.setattr(matrix, "BLOCK", 6)
    monkeypatch.setattr(matrix, "PAIRS_PER_PASS", 3)
    monkeypatch.setattr(matrix.collect_blocks, "__defaults__", (6, False))


def correlated(n=80, d=20, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 5)) @ rng.normal(size=(5, d)) + 0.3 * rng.normal(size=(n, d)) + 4.0


def test_covariance_and_distances_in_blocks(spark, small_blocks):
    x = correlated()
    df = frame(spark, x)
    expected = np.cov(x.T, bias=True)
    for r in matrix.covariance(df).collect():
        assert np.isclose(r["cov_pop"], expected[r["i"], r["j"]])
    rows = matrix.squared_distances(df).collect()
    assert len(rows) == 20 * 19 // 2
    for r in rows:
        assert np.isclose(r["dist2"], ((x[:, r["i"]] - x[:, r["j"]]) ** 2).sum())


def numpy_axes(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-values)[:k]
    return values[order], reduce.fix_signs(vectors[:, order])


def test_pca(spark, small_blocks):
    x = correlated()
    model = make_reducer("pca_dr", num_features=4).fit(frame(spark, x))
    values, axes = numpy_axes(x, 4)
    assert np.allclose(model.components, axes, atol=1e-8) and np.allclose(model.variance, values)
    assert np.allclose(model.components.T @ model.components, np.eye(4), atol=1e-10)
    assert model.variance.sum() <= model.total_variance * (1 + 1e-12)
    assert np.allclose(to_numpy(model.transform(frame(spark, x))), (x - x.mean(0)) @ axes)
    assert model.names_out == ["PCA_0", "PCA_1", "PCA_2", "PCA_3"]


@pytest.mark.parametrize("method", ["pca_dr", "kbest+pca"])
def test_fold_models_from_one_scan_equal_single_fits(spark, small_blocks, monkeypatch, method):
    x, y = correlated(n=90), np.arange(90) % 3
    df = frame(spark, x + 1e3, y).withColumn("fold", F.pmod(F.floor(F.col("row_id") / 7), F.lit(3)).cast("int")).persist()
    estimator = make_reducer(method, num_features=5)
    together = estimator.fit_folds(df, 3)
    monkeypatch.setattr(reduce, "FOLD_BYTES", 0)
    for i, single in estimator.fit_folds(df, 3).items():
        assert np.allclose(np.abs(single.components), np.abs(together[i].components), atol=1e-6)
        assert np.allclose(to_numpy(single.transform(df)), to_numpy(together[i].transform(df)), atol=1e-5)


def test_basis_in_slices(spark, monkeypatch):
    x, q = correlated(), np.random.default_rng(2).normal(size=(20, 7))
    monkeypatch.setattr(matrix, "MAX_BROADCAST_BYTES", 8 * 20 * 3)
    centred = x - x.mean(0)
    assert np.allclose(matrix.normal_equations_pass(frame(spark, x), q, x.mean(0)), centred.T @ (centred @ q))


def test_wide_pca_agrees_with_the_covariance(spark, small_blocks):
    x = correlated()
    df = frame(spark, x)
    axes, means, values, total = reduce.principal_axes(df, 4, seed=1, gram_limit=10)
    expected_values, expected = numpy_axes(x, 4)
    assert np.allclose(np.abs((axes * expected).sum(0)), 1, atol=1e-6)
    assert np.allclose(values, expected_values, rtol=1e-6) and np.isclose(total, np.trace(np.cov(x.T)))


def test_projection_in_slices(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MAX_BROADCAST_BYTES", 8 * 20 * 3)
    x, w = correlated(), np.random.default_rng(1).normal(size=(20, 8))
    assert np.allclose(to_numpy(matrix.project(frame(spark, x), w, np.arange(8.0))), x @ w - np.arange(8.0))


def test_missing_values_are_refused_with_a_clear_message(spark):
    x = correlated()
    x[3, 2] = np.nan
    with pytest.raises(Exception, match="impute the table first"):
        make_reducer("pca_dr", num_features=2).fit(frame(spark, x))


def test_random_projection_ignores_the_data(spark):
    a = make_reducer("random_dr", num_features=5, seed=3).fit(frame(spark, correlated(seed=1)))
    b = make_reducer("random_dr", num_features=5, seed=3).fit(frame(spark, correlated(seed=2)))
    c = make_reducer("random_dr", num_features=5, seed=4).fit(frame(spark, correlated(seed=2)))
    assert np.array_equal(a.components, b.components) and not np.allclose(a.components, c.components)
    wide = frame(spark, np.zeros((2, 2000)))
    assert abs(make_reducer("random_dr", num_features=16).fit(wide).components.std() - 0.25) < 0.01


def naive_ward(x, k):
    """Greedy merging by the increase of the within-cluster sum of squares, columns as points."""
    clusters = [[i] for i in range(x.shape[1])]
    while len(clusters) > k:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                ca, cb = x[:, clusters[a]].mean(1), x[:, clusters[b]].mean(1)
                na, nb = len(clusters[a]), len(clusters[b])
                cost = na * nb / (na + nb) * ((ca - cb) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        clusters[a] = sorted(clusters[a] + clusters.pop(b))
    return sorted(clusters)


@pytest.mark.parametrize("k", [1, 4, 9, 20])
def test_ward_chain(spark, k):
    x = correlated(seed=4)
    assert ward.ward_clusters(frame(spark, x), k) == naive_ward(x, k)


def test_ward_distributed(spark):
    x = correlated(seed=5)
    merged = ward.distributed_merges(ward.distance_rows(frame(spark, x)), 20)
    for k in (1, 3, 7, 12, 20):
        assert ward.cut_tree(merged, 20, k) == naive_ward(x, k)


def test_ward_model_pools(spark):
    x = correlated(seed=6)
    model = make_reducer("agglo_dr", num_features=5).fit(frame(spark, x))
    assert model.clusters == naive_ward(x, 5)
    expected = np.column_stack([x[:, c].mean(1) for c in model.clusters])
    assert np.allclose(to_numpy(model.transform(frame(spark, x))), expected)


def exact_kernel_pca(x, k, gamma):
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    n = len(x)
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(centre @ kernel @ centre)
    order = np.argsort(-values)[:k]
    return vectors[:, order] * np.sqrt(values[order])


def test_kernel_pca_with_all_landmarks_is_exact(spark):
    x = correlated(n=40, d=6) / 4
    df = frame(spark, x)
    model = make_reducer("kpca_dr", num_features=3, num_landmarks=100).fit(df)
    found, expected = to_numpy(model.transform(df)), exact_kernel_pca(x, 3, 1 / 6)
    signs = np.sign((found * expected).sum(0))
    assert np.allclose(found, expected * signs, atol=1e-6)


def test_kernel_pca_with_few_landmarks_is_close(spark):
    x = correlated(n=120, d=4) / 6
    df = frame(spark, x)
    found = to_numpy(make_reducer("kpca_dr", num_features=1, num_landmarks=60).fit(df).transform(df))[:, 0]
    assert abs(np.corrcoef(found, exact_kernel_pca(x, 1, 0.25)[:, 0])[0, 1]) > 0.99


def test_kbest_and_pca(spark):
    rng = np.random.default_rng(7)
    x, y = correlated(n=90, seed=7), rng.integers(0, 3, 90)
    x[:, [2, 9]] += 5 * y[:, None]
    df = frame(spark, x, y)
    model = make_reducer("kbest+pca", num_features=8, fs_ratio=0.25).fit(df)
    assert model.selected == [2, 9] and model.names_out == ["f2", "f9", *[f"PCA_{i}" for i in range(6)]]
    rest = np.delete(x, [2, 9], axis=1)
    _, axes = numpy_axes(rest, 6)
    assert np.allclose(to_numpy(model.transform(df)), np.hstack([x[:, [2, 9]], (rest - rest.mean(0)) @ axes]))
    everything = make_reducer("kbest+pca", num_kbest_features=20, num_pca_comps=3).fit(df)
    assert everything.names_out == [f"f{i}" for i in range(20)]


@pytest.mark.parametrize("method", ["pca_dr", "random_dr", "agglo_dr", "kpca_dr", "kbest+pca", "kbest_fs", "original"])
def test_models_survive_saving(spark, tmp_path, method):
    x = correlated(n=50)
    df = frame(spark, x, np.arange(50) % 2)
    model = make_reducer(method, num_features=4, num_landmarks=50).fit(df)
    model.save(str(tmp_path / "m"))
    again = ReducerModel.load(str(tmp_path / "m"))
    assert type(again) is type(model) and again.names_out == model.names_out
    assert np.array_equal(to_numpy(again.transform(df)), to_numpy(model.transform(df)))


def test_estimators_survive_saving(spark, tmp_path):
    estimator = make_reducer("pca_dr", num_features=7, seed=3)
    estimator.save(str(tmp_path / "e"))
    again = REDUCERS["pca_dr"].load(str(tmp_path / "e"))
    assert again.get("num_features") == 7 and again.get("seed") == 3


@pytest.mark.parametrize("method", ["random_fs", "kbest_fs", "pca_dr", "agglo_dr", "lasso_fs", "sand_fs", "tabpfn_fs"])
def test_too_many_features_is_an_error(spark, method):
    with pytest.raises(ValueError):
        make_reducer(method, num_features=99).fit(frame(spark, correlated(n=30), np.arange(30) % 2))


def test_unknown_method():
    with pytest.raises(ValueError, match="unknown method"):
        make_reducer("magic")
    assert len(REDUCERS) == 13


def test_transform_is_row_local(spark):
    df = frame(spark, correlated())
    for method in ("pca_dr", "random_dr", "agglo_dr", "random_fs"):
        plan = make_reducer(method, num_features=4).fit(df).transform(spark.range(5).select(F.array_repeat(F.col("id").cast("double"), 20).alias("features")))
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
