"""Findings of round 3: cuts and equal rows of boosted trees, ranges of prefix sums, passes of wide components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import spark_queries
from tests.conftest import frame
from widetab.operators import boosting, matrix, ranks, reduce
from widetab.operators.boosting import HistogramBoosting


def test_small_ranges_do_not_make_a_task_each(spark):
    data = [(float(i), int(i % 3)) for i in range(2000)]
    found = ranks.running_totals(spark.createDataFrame(data, "o double, n bigint"), "o", ["n"], 1)
    assert found.rdd.getNumPartitions() <= ranks.MAX_RANGES
    rows = sorted((r["o"], r["n_before"]) for r in found.collect())
    assert [b for _, b in rows] == [0, *np.cumsum([n for _, n in data])[:-1].tolist()]


@pytest.mark.parametrize("pivots", [4, 2048])
def test_cuts_are_quantiles_of_all_rows(spark, monkeypatch, pivots):
    monkeypatch.setattr(boosting, "AT_ONCE", 10, raising=False)
    monkeypatch.setattr(boosting, "MOST_PIVOTS", pivots, raising=False)
    rng = np.random.default_rng(21)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 5, 900), np.full(900, 2.0), np.exp(3 * rng.normal(size=900))])
    cuts = boosting.cut_points(frame(spark, x), 16, 100, 0)
    for j in range(4):
        points = np.unique(np.quantile(x[:, j], [i / 16 for i in range(1, 16)]))
        assert np.allclose(cuts[j], points[points < x[:, j].max()], rtol=1e-12)


def test_equal_rows_are_learned_from_as_one(spark, monkeypatch):
    rng = np.random.default_rng(22)
    x = rng.integers(0, 4, (120, 3)).astype(float)
    y = (x[:, 0] > 1).astype(int) + (x[:, 1] > x[:, 2]).astype(int)
    df = frame(spark, np.tile(x, (5, 1)), np.tile(y, 5))
    kept, store = [], boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda rows: kept.append(store(rows)) or kept[-1])
    learner = HistogramBoosting("multiclass", 3, maxIter=4, maxDepth=3, maxBins=8, validation=0.2)
    merged = learner.fit(df)
    assert kept[0].count() <= 2 * len(np.unique(np.column_stack([x, y]), axis=0)) and kept[0].agg(F.sum("copies")).first()[0] == 600
    kept.clear()
    monkeypatch.setattr(boosting, "distinct_rows", lambda coded, base: store(coded.select(
        "*", boosting.vectors.array_literal(base.ravel()).alias("margins"), F.lit(1).cast("bigint").alias("copies"))))
    plain = learner.fit(df)
    assert len(merged.trees) == len(plain.trees) > 0 and (merged.scores(x) == plain.scores(x)).all()


def test_few_passes_find_the_axes_of_few_ranks(spark, monkeypatch):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(150, 64)) @ rng.normal(size=(64, 200))
    passes, run = [], matrix.normal_equations_pass
    monkeypatch.setattr(matrix, "normal_equations_pass", lambda *a, **k: passes.append(1) or run(*a, **k))
    axes, _, values, _ = reduce.principal_axes(frame(spark, x), 8, gram_limit=10)
    cov = np.cov(x, rowvar=False)
    assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1][:8]) and len(passes) <= 4
    assert (np.linalg.norm(cov @ axes - axes * values, axis=0) <= 1e-6 * values[0]).all()


def test_kernel_rows_are_computed_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(300, 4))
    sizes, run = [], matrix.kernel_rows
    monkeypatch.setattr(matrix, "KERNEL_CELLS", 400, raising=False)
    batch = matrix.pa.RecordBatch.from_arrays([matrix.list_column(x)], names=["features"])
    pieces = list(matrix.row_pieces(len(x), 20))
    assert [p.start for p in pieces] == list(range(0, 300, 20)) and pieces[-1].stop == 300 and batch.num_rows == 300
    df = frame(spark, x)
    marks, residual = reduce.kernel_landmarks(df, 0.2, 0.9)
    monkeypatch.setattr(matrix, "KERNEL_CELLS", 1 << 20, raising=False)
    again, same = reduce.kernel_landmarks(df, 0.2, 0.9)
    assert marks.ids == again.ids and abs(residual - same) < 1e-12


def test_very_wide_rows_are_built_in_small_lots_by_numpy(spark, tmp_path):
    """F8: a lambda of Spark's, called for each of 6,000 features, took 63 of 77 s on 24,000 rows."""
    e = np.random.default_rng(24).normal(size=(450, 64)).astype(np.float32)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(e)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = spark_queries.very_wide(spark, str(tmp_path))
    assert "lambdafunction" not in df._jdf.queryExecution().executedPlan().toString()
    rows = sorted(df.collect(), key=lambda r: r["row_id"])
    assert [(r["row_id"], r["label"]) for r in rows] == [(i, i % 3) for i in range(450)]
    for i in (0, 174, 449):
        x = [float(v) for v in e[i]]
        assert rows[i]["features"] == [x[j % 64] * (1.0 + (j % 7) / 10.0) + x[(j * 5 + 3) % 64] * ((j % 11) / 10.0 - 0.5) for j in range(6000)]
