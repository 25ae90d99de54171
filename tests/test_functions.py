import hashlib
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from widetab.functions import naming, rng, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_md5_bucket_equals_integer_of_digest(spark):
    keys = ["", "a", "model_7", "ä"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for n in (1, 10, 997, 2**31 - 1):
        found = [r[0] for r in df.select(rng.md5_bucket(F.col("k"), n)).collect()]
        assert found == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k in keys]


def test_uniform_and_normal_have_the_right_moments(spark):
    df = spark.range(20000)
    row = df.select(rng.uniform(1, F.col("id")).alias("u"), rng.normal(1, F.col("id")).alias("z")).agg(
        F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")
    ).first()
    assert 0 <= row[0] and row[1] < 1
    assert abs(row[2] - 0.5) < 0.01 and abs(row[3]) < 0.03 and abs(row[4] - 1) < 0.02


def test_hash_does_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    total = lambda d: d.agg(F.sum(rng.hash52(5, F.col("id")).cast("decimal(38,0)"))).first()[0]
    assert total(df) == total(df.repartition(7)) == total(df.coalesce(1))


def test_long_and_short_take_agree(spark):
    values = [float(i) for i in range(200)]
    idx = list(np.random.default_rng(0).permutation(200))
    row = one(spark, short=vectors.take(vectors.array_literal(values), idx[:20]), long=vectors.take(vectors.array_literal(values), idx))
    assert row.short == [float(i) for i in idx[:20]] and row.long == [float(i) for i in idx]


def test_bind(spark):
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    assert one(spark, b=vectors.bind(F.array(F.lit(1), F.lit(2)), lambda a: total(a) + F.size(a))).b == 5
    assert one(spark, g=vectors.gather(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1), F.lit(0), F.lit(1)))).g == [2.0, 1.0, 2.0]


def test_complement(spark):
    assert one(spark, c=vectors.complement(5, [3, 0])).c == [1, 2, 4]
    assert one(spark, c=vectors.complement(2, [0, 1])).c == []
    assert one(spark, c=vectors.complement(0, [])).c == []


def test_pool_and_fill(spark):
    values = F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0, 5.0)])
    gaps = F.array(F.lit(1.0), F.lit(None).cast("double"))
    row = one(spark, p=vectors.pool(values, [[0, 2], [1, 3]]), f=vectors.fill(gaps, [9.0, 8.0]))
    assert row.p == [2.0, 3.5] and row.f == [1.0, 8.0]


def test_nonfinite(spark):
    bad = F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(None).cast("double"), F.lit(2.0))
    assert one(spark, c=vectors.clean_nonfinite(bad)).c == [0.0, 0.0, 0.0, 0.0, 2.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=2, max_size=6), st.integers(1, 4))
def test_gate_norm(spark, weights, k):
    gate = one(spark, g=vectors.project_gate(vectors.array_literal(weights), k)).g
    if any(abs(w) > 1e-3 for w in weights):
        assert math.isclose(sum(g * g for g in gate), k, rel_tol=1e-6)


@pytest.mark.parametrize("raw, expected", [("A b--C", "a_b_c"), ("__x__", "x"), ("!!", ""), ("9 Lives", "9_lives")])
def test_slug(spark, raw, expected):
    assert one(spark, s=text.slug(F.lit(raw))).s == expected


def test_names(spark):
    names = ["d_num_features_150_x.csv", "d_num_features-20", "num_features  7", "none"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.width_from_name(F.col("n"))).collect()] == [150, 20, 7, None]
    row = one(spark, h=text.hyperparams_from_name(F.lit("/a_s9_nf1/x_s42_nf150_vt0.95_nte10.csv")), none=text.hyperparams_from_name(F.lit("x.csv")))
    assert row.h.asDict() == {"seed": 42, "nf": 150, "vt": 0.95, "nte": 10} and row.none is None


def test_key_values(spark):
    lines = ["a: 1", "b: -2.5", " c : TRUE ", "d: x y", "# comment", "e:", "f: 1.", "g: 1e5"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = {r["key"]: r for r in text.parse_key_values(df).collect()}
    assert set(rows) == {"a", "b", "c", "d", "f", "g"}
    assert rows["a"].int_value == 1 and rows["b"].float_value == -2.5 and rows["c"].bool_value is True
    assert [rows[k].kind for k in "abcdfg"] == ["int", "float", "bool", "string", "string", "string"]


def nested_find(node, key):
    """Depth-first: own entry, then children in order; lists are looked into one level."""
    if key in node:
        return node[key]
    for v in node.values():
        for child in v if isinstance(v, list) else [v]:
            if isinstance(child, dict) and (hit := nested_find(child, key)) is not None:
                return hit
    return None


def test_deep_find(spark):
    docs = [
        {"k": 1}, {"a": {"k": 2}, "b": 3}, {"a": {"x": {"k": 3}}, "k": 4}, {"z": {"y": {"k": 5}}, "b": {"k": 6}},
        {"l": [1, {"k": "seven"}]}, {"l": [[{"k": 8}]]}, {"k": None, "a": {"k": 9}}, {"a": {"k": None}, "b": {"k": 10}}, [],
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "{bad")], "i int, t string")
    found = {r[0]: r[1] for r in df.select("i", text.deep_find(F.col("t"), "k")).collect()}
    for i, d in enumerate(docs):
        hit = nested_find(d, "k") if isinstance(d, dict) else None
        assert found[i] == (None if hit is None else str(hit)), d
    assert found[99] is None


def test_budget_rounds_half_to_even(spark):
    assert naming.split_budget(150) == (112, 38)
    k1, k2 = naming.split_budget_columns(F.lit(150))
    assert tuple(one(spark, a=k1, b=k2)) == (112, 38)


def test_metrics_by_task():
    assert naming.metrics_for("regression") == ["rmse", "norm_rmse"]
    with pytest.raises(ValueError):
        naming.metrics_for("ranking")


def test_task_type_from_text(spark):
    texts = [("Supervised Classification", 2), ("Supervised classification", 5), ("Supervised Regression", 0), ("Clustering", 3)]
    df = spark.createDataFrame(texts, "t string, c int")
    found = [r[0] for r in df.select(naming.task_type_from_text(F.col("t"), F.col("c"))).collect()]
    assert found == ["binary", "multiclass", "regression", None]
