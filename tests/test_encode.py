import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from widetab.operators import encode, impute
from widetab.operators.encode import ColumnEncoder, LabelCoder
from widetab.plans.prepare import prepare


def test_label_codes_follow_the_type_and_the_training_rows(spark):
    train = spark.createDataFrame([(10,), (2,), (7,), (2,)], "label int")
    coder = LabelCoder().fit(train)
    assert coder.classes == [2, 7, 10]
    test = spark.createDataFrame([(7,), (8,), (None,), (10,)], "label int")
    assert [r[0] for r in coder.transform(test).collect()] == [1, None, None, 2]
    assert coder.unseen(test) == 1


def test_many_classes_are_joined(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("label"))
    coder = LabelCoder(out="code").fit(df)
    assert coder.transform(df).filter(F.col("code") != F.col("label") / 3).count() == 0


@pytest.fixture
def mixed(spark):
    rows = [
        (0, "a", 1.0, True, "x", 5, 1.0, "k", datetime.datetime(2024, 1, 7), None),
        (1, "b", 2.0, False, "y", 9, 2.0, "k", datetime.datetime(2024, 2, 1), None),
        (2, "a", 3.0, True, "y", 5, 3.0, "k", datetime.datetime(2023, 12, 31), None),
        (3, "c", 4.0, True, "z", 9, 4.0, "k", None, None),
    ]
    return spark.createDataFrame(
        rows, "row_id bigint, label string, n double, flag boolean, cat string, two int, again double, const string, day timestamp, none double"
    )


def test_encoding(spark, mixed):
    model = ColumnEncoder().fit(mixed)
    assert set(model.constant) == {"const", "none"} and model.duplicates == {"again": "n"}
    assert model.names_out == ["n", "flag", "cat", "two", "day", "day.year", "day.month", "day.day", "day.dayofweek"]
    rows = {r["row_id"]: r["features"] for r in model.transform(mixed).collect()}
    assert rows[0][:4] == [1.0, 1.0, 0.0, 0.0] and rows[3][:4] == [4.0, 1.0, 2.0, 1.0]
    assert rows[0][5:] == [2024, 1, 7, 1] and rows[3][4:] == [None] * 5


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_wall_clock_times_do_not_depend_on_the_zone(spark, zone):
    df = spark.sql("SELECT 1L AS row_id, TIMESTAMP_NTZ'1970-01-02 00:00:01' AS t UNION ALL SELECT 2L, TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = ColumnEncoder(label=None).fit(df).transform(df).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r["features"][1:] for r in rows] == [[1970, 1, 2, 6], [1970, 1, 1, 5]]
    assert rows[0]["features"][0] == 86401e6 and rows[1]["features"][0] == 0


def test_unseen_values_take_the_most_frequent_code(spark, mixed):
    model = ColumnEncoder().fit(mixed)
    other = mixed.filter("row_id = 0").withColumn("cat", F.lit("new")).withColumn("two", F.lit(6))
    values = model.transform(other).first()["features"]
    assert values[2] == 1.0 and values[3] is None


def test_long_code_tables_are_joined(spark):
    df = spark.range(700).select(F.col("id").alias("row_id"), F.format_string("v%04d", F.col("id") % 350).alias("s"), (F.col("id") % 3).cast("string").alias("t"))
    model = ColumnEncoder(label=None).fit(df)
    assert list(model.tables) == ["s"] and list(model.literal) == ["t"]
    out = model.transform(df)
    assert out.count() == 700
    assert out.filter((F.get("features", F.lit(0)) != F.col("row_id") % 350) | (F.get("features", F.lit(1)) != F.col("row_id") % 3)).count() == 0
    assert model.transform(df.limit(1).withColumn("s", F.lit("?"))).first()["features"][0] == 0.0


def test_equal_fingerprints_are_confirmed(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, 3.0, 3.0, 3.0)], "row_id int, a double, b double, c double")
    same = lambda df, columns, row_id, dtype: spark.createDataFrame([(c, 1, 1) for c in columns], "column string, fp1 bigint, fp2 bigint")
    monkeypatch.setattr(encode, "column_fingerprints", same)
    assert encode.duplicate_columns(df, ["a", "b", "c"], "row_id") == {"b": "a"}


def test_test_rows_never_reach_the_fit(spark, mixed):
    train, test = mixed.filter("row_id < 3"), mixed.filter("row_id = 3")
    changed = test.withColumn("n", F.lit(1e9)).withColumn("cat", F.lit("zzz"))
    first = prepare(train, test, "multiclass").train.orderBy("row_id").collect()
    assert first == prepare(train, changed, "multiclass").train.orderBy("row_id").collect()


def test_imputation_from_training_or_own_statistics(spark):
    train = spark.createDataFrame([(1.0, "a", None), (3.0, "a", None), (None, "b", None)], "n double, s string, e double")
    test = spark.createDataFrame([(None, None, None), (10.0, "b", 4.0)], "n double, s string, e double")
    _, from_train = impute.impute_parts(train, test)
    assert [tuple(r) for r in from_train.collect()] == [(2.0, "a", 0.0), (10.0, "b", 4.0)]
    _, own = impute.impute_parts(train, test, own_stats=True)
    assert [tuple(r) for r in own.collect()] == [(10.0, "b", 4.0), (10.0, "b", 4.0)]


def test_feature_imputer(spark):
    df = spark.createDataFrame([(0, [1.0, None, float("nan")]), (1, [3.0, None, 5.0])], "row_id int, features array<double>")
    out = impute.FeatureImputer().fit(df).transform(df).orderBy("row_id").collect()
    assert [r["features"] for r in out] == [[1.0, 0.0, 5.0], [3.0, 0.0, 5.0]]


def test_prepared_parts_have_no_gaps(spark, mixed):
    prepared = prepare(mixed.filter("row_id <> 3"), mixed.filter("row_id = 3"), "multiclass")
    assert prepared.classes == ["a", "b"] and prepared.names[:2] == ["n", "flag"]
    row = prepared.test.first()
    assert row["label"] is None and not any(v is None or np.isnan(v) for v in row["features"])
