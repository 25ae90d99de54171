import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, to_numpy
from widetab.operators import layout, metrics, stats


def anova(x, y):
    classes = [x[y == c] for c in np.unique(y)]
    between = sum(len(c) * (c.mean(0) - x.mean(0)) ** 2 for c in classes) / (len(classes) - 1)
    return between / (sum(((c - c.mean(0)) ** 2).sum(0) for c in classes) / (len(x) - len(classes)))


def scores(df):
    return [r["score"] for r in df.orderBy("feature_idx").collect()]


def test_anova(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(90, 5)) + 1e6, rng.integers(0, 3, 90)
    assert np.allclose(scores(stats.anova_scores(frame(spark, x, y))), anova(x, y), rtol=1e-6)


def test_anova_undefined_and_perfect_scores(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 5.0], [1.0, 5.0]])
    assert scores(stats.anova_scores(frame(spark, x, np.array([0, 0, 1, 1])))) == [None, math.inf]
    assert scores(stats.anova_scores(frame(spark, x, np.array([0, 0, 0, 0])))) == [None, None]


def test_regression_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x[:, 1] + rng.normal(size=60)
    x[:, 3] = 7.0
    r2 = np.array([np.corrcoef(x[:, j], y)[0, 1] ** 2 for j in range(3)])
    found = scores(stats.regression_scores(frame(spark, x, y)))
    assert np.allclose(found[:3], r2 / (1 - r2) * 58) and found[3] == 0.0
    assert scores(stats.regression_scores(frame(spark, y[:, None] * 2 + 1, y)))[0] > 1e12


def test_fold_statistics_by_merging_equal_direct_ones(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(120, 6)) * 10 + 1e5, rng.integers(0, 3, 120)
    df = frame(spark, x, y).withColumn("fold", F.pmod("row_id", F.lit(4)).cast("int"))
    merged = stats.anova_from_moments(stats.training_moments(stats.feature_moments(df, ["fold", "label"]), 4), ["fold"])
    for fold in range(4):
        keep = np.arange(120) % 4 != fold
        assert np.allclose(scores(merged.filter(F.col("fold") == fold)), anova(x[keep], y[keep]), rtol=1e-6)


def test_missing_statistics(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None, "b", None), (None, float("nan"), None, "a", None), (3, 4.0, None, None, None)],
        "i int, d double, e double, s string, t string",
    )
    assert stats.missing_cells(df).first()[0] == 1 + 1 + 3 + 1 + 3
    means = {r["column"]: r["mean"] for r in stats.column_means(df).collect()}
    assert means == {"i": 2.0, "d": 3.0, "e": 0.0}
    modes = {r["column"]: (r["mode"], r["count"]) for r in stats.column_modes(df).collect()}
    assert modes == {"s": ("a", 1), "t": ("missing", 0)}


def test_constant_feature_gets_scale_one_and_jitter(spark):
    x = np.array([[1.0, 2.0], [1.0, 3.0], [1.0, 4.0]])
    df = frame(spark, x)
    rows = {r["feature_idx"]: r for r in stats.standard_scales(df).collect()}
    assert rows[0]["scale"] == 1.0 and math.isclose(rows[1]["scale"], x[:, 1].std())
    found = to_numpy(stats.break_constant(df, 1e-6, 1))
    assert found[:, 0].std() > 0 and np.abs(found[:, 0] - 1).max() < 1e-5 and (found[:, 1] == x[:, 1]).all()


@pytest.mark.parametrize("values, expected", [
    ([0, 1] * 5, "binary"), (["a", "b", "c"], "multiclass"), (list(range(25)), "regression"), ([1, None, 2, None], "multiclass"),
])
def test_task_type(spark, values, expected):
    kind = "string" if isinstance(values[0], str) else "int"
    assert stats.infer_task_type(spark.createDataFrame([(v,) for v in values], f"label {kind}")) == expected


def test_task_type_errors(spark):
    for values in (["x"], [f"v{i}" for i in range(30)]):
        with pytest.raises(ValueError, match="task_type"):
            stats.infer_task_type(spark.createDataFrame([(v,) for v in values], "label string"))
    assert stats.infer_task_type(spark.range(3), given="regression") == "regression"


def test_report_ranks_ties_and_undefined_scores(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0), (3, 1.0)], "feature_idx int, score double")
    report = stats.feature_report(df, 2).orderBy("rank").collect()
    assert [r["feature_idx"] for r in report] == [2, 0, 3, 1] and [r["selected"] for r in report] == [True, True, False, False]


def test_column_kinds_and_layouts(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True, None)], "i int, d double, s string, b boolean, t timestamp")
    assert [layout.columns_by_type(df, k) for k in ("number", "string", "boolean", "datetime")] == [["i", "d"], ["s"], ["b"], ["t"]]
    with pytest.raises(ValueError):
        layout.columns_by_type(df, "struct")
    array = layout.to_array(df, ["i", "d"], "s", "i")
    assert tuple(array.first()) == (1, "x", [1.0, 2.0])
    assert layout.to_wide(array, ["a", "b"]).first().asDict() == {"row_id": 1, "label": "x", "a": 1.0, "b": 2.0}
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>")
    with pytest.raises(ValueError, match="between 1 and 2"):
        layout.width(uneven)


def test_row_ids_are_written_down(spark):
    df = layout.with_row_id(spark.range(100).select(F.col("id").alias("v")))
    first = {r["v"]: r["row_id"] for r in df.collect()}
    assert len(set(first.values())) == 100
    assert first == {r["v"]: r["row_id"] for r in df.repartition(5).collect()}


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("per_bucket", [2, 10**6])
def test_auc(spark, per_bucket):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    assert math.isclose(metrics.roc_auc(df, rows_per_bucket=per_bucket).first()[0], brute_auc(y, s), rel_tol=1e-12)
    assert metrics.roc_auc(df.filter("label = 1")).first()[0] is None


def test_evaluate(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [1.0, 0.0])], "label int, probability array<double>")
    expected = -(math.log(0.9) + math.log(1e-15)) / 2
    assert math.isclose(metrics.evaluate(df, "multiclass")["log_loss"], expected, rel_tol=1e-9)
    assert metrics.evaluate(df, "binary") == {"roc_auc": 0.0}
    flat = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "label double, prediction double")
    assert metrics.evaluate(flat, "regression") == {"rmse": 0.5, "norm_rmse": None}
    with pytest.raises(ValueError):
        metrics.evaluate(df, "ranking")


def test_missing_cells_of_three_thousand_columns(spark):
    columns = [F.when(F.col("id") % (i + 2) == 0, F.lit(None)).otherwise(F.col("id")).alias(f"c{i}") for i in range(3_000)]
    expected = sum(1 for i in range(3_000) for n in range(3) if n % (i + 2) == 0)
    assert stats.missing_cells(spark.range(3).select(*columns)).first()["missing_cells"] == expected
