import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from widetab.operators import ranks, split


def labelled(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "row_id bigint, label string")


def parts(df):
    return {r["row_id"]: r["part"] for r in df.collect()}


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(4, 60), min_size=2, max_size=4), st.integers(0, 5))
def test_holdout_is_exact_complete_and_stratified(spark, sizes, seed):
    found = split.holdout(labelled(spark, sizes), 0.3, seed, "label").toPandas()
    n = sum(sizes.values())
    assert sorted(found["row_id"]) == list(range(n))
    assert (found["part"] == "test").sum() == math.ceil(0.3 * n)
    for label, size in sizes.items():
        share = math.ceil(0.3 * n) * size / n
        assert abs(((found["label"] == label) & (found["part"] == "test")).sum() - share) < 1


@pytest.mark.parametrize("k", [1, 7, 64])
def test_splits_do_not_depend_on_partitioning(spark, k):
    df = labelled(spark, {"a": 40, "b": 21, "c": 9})
    assert parts(split.holdout(df, 0.3, 1, "label")) == parts(split.holdout(df.repartition(k), 0.3, 1, "label"))
    folds = lambda d: {r["row_id"]: r["fold"] for r in split.kfold(d, 4, 1, "label").collect()}
    assert folds(df) == folds(df.repartition(k))


def test_holdout_follows_the_hash_order(spark):
    df = labelled(spark, {"a": 50})
    keyed = df.select("row_id", split.hash52(3, F.col("row_id")).alias("key")).toPandas().sort_values(["key", "row_id"])
    test = {i for i, p in parts(split.holdout(df, 0.2, 3)).items() if p == "test"}
    assert test == set(keyed["row_id"][:10])


def test_holdout_errors(spark):
    with pytest.raises(ValueError, match="two rows"):
        split.holdout(labelled(spark, {"a": 9, "b": 1}), 0.3, 0, "label")
    with pytest.raises(ValueError, match="empty"):
        split.holdout(labelled(spark, {"a": 5}).limit(0), 0.3)
    with pytest.raises(ValueError, match="classes"):
        split.holdout(labelled(spark, {c: 2 for c in "abcdef"}), 0.3, 0, "label")
    with pytest.raises(ValueError, match="no class"):
        split.holdout(labelled(spark, {"a": 5, None: 4}), 0.3, 0, "label")


def test_folds_are_balanced_with_a_hot_class(spark):
    df = labelled(spark, {"hot": 500, "b": 17, "c": 5})
    found = split.kfold(df, 7, 2, "label").toPandas()
    assert len(found) == 522 and found["row_id"].is_unique
    sizes = found.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1
    inside = found.groupby(["label", "fold"]).size().unstack(fill_value=0)
    assert ((inside.max(axis=1) - inside.min(axis=1)) <= 1).all()


def test_cut_offs_and_ranks_give_the_same_folds(spark):
    df = labelled(spark, {"a": 103, "b": 40, "c": 3})
    by_cut = {r["row_id"]: r["fold"] for r in split.kfold(df, 8, 5, "label").collect()}
    by_rank = {r["row_id"]: r["chunk"] for r in split.chunk_table(df, 8, 5, "label").collect()}
    assert by_cut == by_rank


def test_many_folds_use_ranks(spark):
    df = labelled(spark, {"a": 150, "b": 60})
    sizes = split.kfold(df, 100, 5, "label").groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 100 and sizes.max() - sizes.min() <= 1


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_ranks_are_exact_for_any_bucket_count(spark, bits):
    df = labelled(spark, {"a": 200, "b": 3})
    rows = df.select(F.col("label").alias("g"), split.hash52(1, F.col("row_id")).alias("key"), F.col("row_id").alias("tie"))
    counted = ranks.Counted(rows, bits)
    found = counted.ranked().toPandas()
    expected = found.sort_values(["key", "tie"]).groupby("g").cumcount() + 1
    assert (found["rank"] == expected.reindex(found.index)).all()
    cuts = counted.cutoffs({"a": [1, 100, 200], "b": [2]})
    for (g, r), (key, tie) in cuts.items():
        row = found[(found["g"] == g) & (found["rank"] == r)].iloc[0]
        assert (row["key"], row["tie"]) == (key, tie)


def test_counts_too_many_for_the_driver_stay_a_table(spark, monkeypatch):
    df = labelled(spark, {"a": 300, "b": 3})
    rows = df.select(F.col("label").alias("g"), split.hash52(1, F.col("row_id")).alias("key"), F.col("row_id").alias("tie"))
    wanted = {"a": [1, 77, 300], "b": [3]}
    local = ranks.Counted(rows)
    expected, order = local.cutoffs(wanted), sorted(tuple(r) for r in local.ranked().collect())
    monkeypatch.setattr(ranks, "LOCAL_COUNTS", 5)
    table = ranks.Counted(rows)
    assert local.local and table.local is None and table.sizes == local.sizes
    assert table.cutoffs(wanted) == expected and sorted(tuple(r) for r in table.ranked().collect()) == order
    table.release()


def test_large_groups_are_counted_again_with_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FIRST_BITS", 2)
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 10)
    df = labelled(spark, {"a": 300, "b": 3})
    rows = df.select(F.col("label").alias("g"), split.hash52(1, F.col("row_id")).alias("key"), F.col("row_id").alias("tie"))
    counted = ranks.Counted(rows)
    assert counted.bits == 5 and counted.sizes == {"a": 300, "b": 3}
    assert counted.counts.agg(F.max("n")).first()[0] < 40
    assert sorted(r["rank"] for r in counted.ranked().filter("g = 'a'").collect()) == list(range(1, 301))


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_running_totals(spark, per_bucket):
    rng = np.random.default_rng(0)
    order = np.unique(rng.normal(size=300) ** 3)
    data = pd.DataFrame({"o": order, "n": rng.integers(0, 9, len(order))})
    found = ranks.running_totals(spark.createDataFrame(data), "o", ["n"], per_bucket).toPandas().sort_values("o")
    assert (found["n_before"].to_numpy() == data["n"].cumsum().to_numpy() - data["n"].to_numpy()).all()


def test_value_at_rank_narrows_down(spark):
    values = np.unique(np.random.default_rng(1).integers(0, 10**9, 700))
    df = spark.createDataFrame([(int(v),) for v in values], "row_id bigint")
    for rank in (1, 350, len(values)):
        assert split._value_at_rank(df, "row_id", rank, len(values), leaf=20) == values[rank - 1]


def test_ordered_split(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert {i for i, p in parts(split.ordered_split(df, 0.85)).items() if p == "train"} == set(range(8))
    assert set(parts(split.ordered_split(df, 0.01)).values()) == {"test"}


def test_chunk_holdout_falls_back_where_a_class_is_too_small(spark):
    rows = [(i, "a" if i % 2 else "b", 0) for i in range(20)] + [(100 + i, "a", 1) for i in range(9)] + [(200, "b", 1)]
    chunked = spark.createDataFrame(rows, "row_id bigint, label string, chunk int")
    found = split.chunk_holdout(chunked, 0.3, 0).toPandas()
    assert found.groupby("chunk")["stratified"].first().to_dict() == {0: True, 1: False}
    tests = found[found["part"] == "test"].groupby("chunk").size().to_dict()
    assert tests == {0: 6, 1: 3}
    assert (found[(found["chunk"] == 0) & (found["part"] == "test")].groupby("label").size() == 3).all()


def test_schedule_seeds(spark):
    one = spark.createDataFrame([("d",)], "dataset string")
    rows = [tuple(r) for r in split.schedule(one, 2, 3, 42).orderBy("repeat", "fold").collect()]
    assert rows[0] == ("d", 0, 0, 42, 42) and rows[-1] == ("d", 1, 2, 142, 144) and len(rows) == 6


def test_holdout_does_not_shuffle_the_features(spark):
    df = labelled(spark, {"a": 30, "b": 30}).withColumn("features", F.array(F.lit(1.0)))
    plan = split.holdout(df, 0.3, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = split.kfold(df, 4, 0, "label")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
