"""The noise gate: parts by chunk, one epoch against numpy, noise by hash, and the gate that is kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import frame
from widetab.operators import gate
from widetab.operators.registry import make_reducer


def test_parts_by_chunk(spark):
    rng = np.random.default_rng(31)
    df = frame(spark, rng.normal(size=(700, 2)), rng.integers(0, 3, 700))
    parts = gate.training_parts(df, 4, True).toPandas()
    assert parts["row_id"].is_unique and len(parts) == 700 and 0.29 < parts["valid"].mean() < 0.32
    again = gate.training_parts(df.repartition(7), 4, True).toPandas()
    assert set(map(tuple, parts.to_numpy())) == set(map(tuple, again.to_numpy()))
    alone = frame(spark, rng.normal(size=(30, 2)), np.arange(30))  # no chunk can hold all classes in both parts
    assert not gate.training_parts(alone, 4, True).toPandas()["valid"].any()


def test_noise_belongs_to_row_epoch_and_feature():
    keys = np.arange(-500, 1500)
    noise = gate.row_noise(3, 2, keys, 40)
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 1) < 0.01 and abs(np.corrcoef(noise[:-1].ravel(), noise[1:].ravel())[0, 1]) < 0.01
    assert (gate.row_noise(3, 2, keys[700:800], 40) == noise[700:800]).all()
    assert not np.isclose(gate.row_noise(3, 3, keys, 40), noise).any(axis=1).all()
    assert not np.isclose(gate.row_noise(4, 2, keys, 40), noise).any(axis=1).all()


@pytest.mark.parametrize("regression", [True, False])
def test_one_epoch_without_noise(spark, planted, regression):
    x, score, _ = planted
    y = score if regression else np.digitize(score, [-1, 1])
    df = frame(spark, x, y)
    parts = {r["row_id"]: r["valid"] for r in gate.training_parts(df, 0, not regression).collect()}
    valid = np.array([parts[i] for i in range(len(x))])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d, k, outputs = 30, 4, 1 if regression else 3
    values = {"gate": np.full(d, np.sqrt(k / d)), "head": np.random.default_rng(1).normal(size=(d, outputs)), "bias": np.zeros(outputs)}
    rows = df.select(F.xxhash64("row_id").alias("_key"), F.col("label").cast("double").alias("label"), "features", F.lit(True).alias("valid"), "row_id")
    flags = spark.createDataFrame([(int(i), bool(v)) for i, v in enumerate(valid)], "row_id bigint, v boolean")
    rows = rows.join(flags, "row_id").withColumn("valid", F.col("v"))
    loss, n, slopes, checked = gate.gradient_pass(rows, d, outputs, values, k, 0.0, 0, 0, regression, x.mean(axis=0), x.std(axis=0), y.mean(), y.std())

    def errors(own, gates, head):
        out = z[own] * gates @ head
        if regression:
            rest = out[:, 0] - (y[own] - y.mean()) / y.std()
            return 0.5 * (rest**2).mean(), rest[:, None]
        p = np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
        picked = p[np.arange(own.sum()), y[own]].copy()
        p[np.arange(own.sum()), y[own]] -= 1
        return -np.log(picked).mean(), p

    gates = gate.projected(values["gate"], k)
    expected, rest = errors(~valid, gates, values["head"])
    assert n == (~valid).sum() and np.isclose(loss, expected) and np.isclose(checked, errors(valid, gates, values["head"])[0])
    assert np.allclose(slopes["head"], (z[~valid] * gates).T @ rest / n)
    assert np.allclose(slopes["gate"], (rest @ values["head"].T * z[~valid]).sum(axis=0) / n)


def test_the_gate_with_the_lowest_validation_loss_is_kept(spark, planted):
    x, score, _ = planted
    df = frame(spark, x, score)
    fit = lambda epochs: make_reducer("sand_fs", num_features=4, task_type="regression", epochs=epochs, lr=0.3, seed=2)
    long = fit(12)
    kept = long.fit(df)
    assert len(long.losses) == 12 and len(long.val_losses) == 13
    best = 1 + int(np.argmin(long.val_losses[1:]))
    short = fit(best).fit(df)
    scores = lambda m: [r["score"] for r in m.report.orderBy("feature_idx").collect()]
    assert np.allclose(scores(kept), scores(short))
