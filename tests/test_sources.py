import json
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import frame
from widetab.operators import split
from widetab.operators.registry import make_reducer
from widetab.plans import experiment, report
from widetab.sources import results, tables
from widetab.streaming import scoring


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("id,a,b,c,flag,t\n1,1,x,?,true,0\n2,NA,nan,null,False,1\n3,2.5,y,,true,0\n4,7,NaN,na,,1\n")
    return path


def test_missing_tokens_and_types(spark, csv):
    df = tables.read_text_columns(spark, str(csv))
    assert tables.infer_types(df) == {"id": "bigint", "a": "double", "b": "string", "c": "double", "flag": "boolean", "t": "bigint"}
    typed = tables.read_labelled_csv(spark, str(csv), "t", row_id="id").orderBy("row_id").collect()
    assert [r["a"] for r in typed] == [1.0, None, 2.5, 7.0] and [r["b"] for r in typed] == ["x", None, "y", None]
    assert [r["c"] for r in typed] == [None] * 4 and [r["flag"] for r in typed] == [True, False, True, None]
    assert [r["label"] for r in typed] == [0, 1, 0, 1]


def test_row_ids_are_given_when_there_are_none(spark, csv):
    df = tables.read_labelled_csv(spark, str(csv), "t")
    assert len({r["row_id"] for r in df.collect()}) == 4
    with pytest.raises(ValueError, match="target"):
        tables.read_labelled_csv(spark, str(csv), "nothing")


def test_appended_test_csv_keeps_the_border(spark, csv, tmp_path):
    other = tmp_path / "test.csv"
    other.write_text("id,b,a,t,extra\n9,z,word,1,5\n")
    df = tables.read_labelled_csv(spark, str(csv), "t", str(other), row_id="id")
    assert dict(df.dtypes)["a"] == "string"  # types hold for both files
    rows = {r["row_id"]: r for r in df.collect()}
    assert [rows[i]["is_test"] for i in (1, 9)] == [False, True] and rows[9]["extra"] == 5 and rows[1]["extra"] is None


def test_task_lookup(spark):
    datasets = spark.createDataFrame([(7, "hiva"), (3, "hiva"), (5, "empty")], "dataset_id int, name string")
    tasks = spark.createDataFrame([(20, 3), (11, 3), (1, 7)], "task_id int, dataset_id int")
    assert tables.find_task(datasets, tasks, "hiva") == 11 and tables.find_task(datasets, tasks, "363620") == 363620
    with pytest.raises(ValueError, match="no data set"):
        tables.find_task(datasets, tasks, "nope")
    with pytest.raises(ValueError, match="no task"):
        tables.find_task(datasets, tasks, "empty")
    batch = {r["name"]: r["task_id"] for r in tables.first_tasks(datasets, tasks).collect()}
    assert batch == {"hiva": 11, "empty": None}


def test_published_task_round_trip(spark, tmp_path):
    spark.range(6).withColumnRenamed("id", "row_id").write.parquet(str(tmp_path / "t"))
    rows = [(i, r, f, "test" if i % 3 == f else "train") for i in range(6) for r in range(2) for f in range(3)]
    spark.createDataFrame(rows, "row_id bigint, repeat int, fold int, part string").write.parquet(str(tmp_path / "s"))
    table, splits = tables.read_task(spark, str(tmp_path / "t"), str(tmp_path / "s"))
    assert table.count() == 6 and tables.split_dimensions(splits) == (2, 3)


def test_bucketed_tasks_join_without_a_shuffle(spark, tmp_path):
    data = spark.range(50).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("features"))
    splits = split.schedule(data.select("row_id"), 2, 2).select("row_id", "repeat", "fold", F.lit("train").alias("part"))
    tables.write_task(data, splits, "demo", 4, str(tmp_path))
    try:
        joined = split.published_parts(*tables.read_saved_task(spark, "demo"))
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == 200
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    finally:
        spark.sql("DROP TABLE demo_data")
        spark.sql("DROP TABLE demo_splits")


def result_rows(spark):
    rows = [("d", "m", meth, 150, r, f, 100 * r, "rmse", 1.0 + f, 0.5, 1.1, 2.0) for meth in ("a", "b") for r in range(2) for f in range(2)]
    return spark.createDataFrame(rows, experiment.RESULT_SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_are_appended_by_method(spark, tmp_path, fmt):
    path = str(tmp_path / "r")
    results.write_results(result_rows(spark).filter("method = 'a'"), path, fmt)
    results.write_results(result_rows(spark).filter("method = 'b'"), path, fmt)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    back = reader.format(fmt).load(path)
    assert {r["method"]: r["count"] for r in back.groupBy("method").count().collect()} == {"a": 4, "b": 4}
    assert (tmp_path / "r" / "dataset_name=d" / "model=m" / "method=b").exists()


def test_configs_keep_plain_values_and_stringify_others(spark, tmp_path):
    config = {"seed": 1, "f": max, "nested": {"l": (1, None, 2.5), "x": True}}
    results.write_config(spark, "run1", config, str(tmp_path / "c"), [1.0, 2.00006])
    results.write_config(spark, "run2", config, str(tmp_path / "c"), [])
    back = {r["run_id"]: json.loads(r["config"]) for r in results.read_configs(spark, str(tmp_path / "c")).collect()}
    assert back["run1"]["nested"] == {"l": [1, None, 2.5], "x": True} and back["run1"]["f"] == str(max)
    assert back["run1"]["avg_fold_time"] == 1.5 and back["run1"]["total_elapsed_time"] == 3.0001
    assert back["run2"]["avg_fold_time"] is None


@pytest.fixture
def result_folder(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "one_results.csv").write_text("dataset_name,model,method,repeat,fold,log_loss,val_log_loss\nd,m1,x,0,0,0.5,0.6\nd,m1,x,0,1,0.7,0.8\n")
    (deep / "two_results.csv").write_text('fold,repeat,method,model,dataset_name,fold_time,roc_auc\n0,0,y,m2,"d, with ""comma""",3.5,0.9\n')
    (deep / "notes.csv").write_text("a,b\n1,2\n")
    (deep / "empty.csv").write_text("")
    return tmp_path


def test_recursive_scan_with_different_headers(spark, result_folder):
    df = results.load_results(spark, str(result_folder), ["fold_time"])
    rows = sorted(df.collect(), key=lambda r: (r["method"], r["fold"]))
    assert [(r["metric"], r["score"], r["val_score"], r["fold_time"]) for r in rows] == [
        ("log_loss", 0.5, 0.6, None), ("log_loss", 0.7, 0.8, None), ("roc_auc", 0.9, None, "3.5")
    ]
    assert rows[2]["dataset_name"] == 'd, with "comma"' and rows[2]["model"] == "m2"
    summary = {r["method"]: r for r in report.run_summary(df).collect()}
    assert math.isclose(summary["x"]["val_mean"], 0.7) and summary["y"]["std"] is None


def write_study(root):
    files = {
        "r1_results.csv": "log_loss,fold\n0.5,0\n0.7,1\n", "r1_config.yaml": "seed: 4\nnum_features: 100\n",
        "x_num_features_200_results.csv": "log_loss\n0.4\nbad\n",
        "r3_results.csv": "log_loss\n0.3\n", "r3_config.yaml": "args:\n  num_features: 300\nother: x\n",
        "r4_results.csv": "log_loss\n0.1\n",
        "x_num_features_5_results.csv": "rmse\n1\n",
        "x_num_features_6_results.csv": "log_loss\nnan\n\n", "x_num_features_6_config.yaml": "num_features: many\n",
        "x_num_features_7_results.csv": "log_loss\n",
    }
    for name, content in files.items():
        (root / name).write_text(content)


def test_width_study_from_files_to_summary(spark, tmp_path):
    write_study(tmp_path)
    rows, files = results.load_width_study(spark, str(tmp_path))
    outcome = {r["file"]: (r["num_features"], r["reason"]) for r in files.collect()}
    assert outcome == {
        "r1_results.csv": (100, "used"), "x_num_features_200_results.csv": (200, "used"), "r3_results.csv": (300, "used"),
        "r4_results.csv": (None, "no width"), "x_num_features_5_results.csv": (5, "no metric column"),
        "x_num_features_6_results.csv": (6, "no valid rows"), "x_num_features_7_results.csv": (7, "no valid rows"),
    }
    assert {r["reason"]: r["n_files"] for r in results.skip_counts(files).collect()}["used"] == 3
    summary = report.width_summary(rows)
    results.write_summary(summary, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).orderBy("num_features").collect()
    assert [(r["num_features"], round(r["log_loss_mean"], 6), round(r["log_loss_std"], 6), r["n_rows"]) for r in back] == [
        (100, 0.6, 0.141421, 2), (200, 0.4, 0.0, 1), (300, 0.3, 0.0, 1)
    ]
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1


def test_outermost_config_value_wins(spark, tmp_path):
    (tmp_path / "a_config.yaml").write_text("args:\n  num_features: 1\nnum_features: 2\n")
    found = results.config_value(results.read_config_files(spark, str(tmp_path)), "num_features").collect()
    assert [r["value"] for r in found] == ["2"]


def test_reports_handle_missing_times_and_names(spark):
    df = result_rows(spark).withColumn("fold_time", F.lit(None).cast("double"))
    row = report.fold_times(df).first()
    assert row["avg_fold_time"] is None and row["total_elapsed_time"] is None
    names = spark.createDataFrame([("m", "Model")], "key string, name string")
    assert {r["display_name"] for r in report.model_comparison(df, names=names).collect()} == {"Model"}
    wide = experiment.metric_columns(df)
    assert {"rmse", "val_rmse", "log_loss"} <= set(wide.columns) and wide.filter("rmse is null").count() == 0
    assert report.comparison_matrix(report.run_summary(df, ("model", "method")), ["a", "b"]).columns == ["model", "a", "b"]


def test_fitted_models_run_on_a_stream(spark, tmp_path, planted):
    x, score, _ = planted
    df = frame(spark, x, score)
    model = make_reducer("kbest_fs", num_features=4, task_type="regression").fit(df)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.limit(120).write.parquet(source)
    for total in (120, 200):
        stream = spark.readStream.schema(df.schema).parquet(source)
        scoring.write_available(scoring.narrow_stream(stream, model), target, state).awaitTermination(60)
        back = spark.read.parquet(target)
        assert back.count() == total and back.select(F.size("features")).distinct().collect()[0][0] == 4
        if total == 120:
            df.join(spark.read.parquet(source).select("row_id"), "row_id", "left_anti").write.mode("append").parquet(source)


def test_malformed_rows_are_counted(spark, tmp_path):
    (tmp_path / "a_results.csv").write_text("method,log_loss\nm,0.5\nm,0.5,7\nm\n")
    (tmp_path / "b_results.csv").write_text("method,log_loss\nm,0.25\n")
    (tmp_path / "c_results.csv").write_text("method,log_loss\n")
    (tmp_path / "d_results.csv").write_text("log_loss,log_loss\n1,2\n")
    found = {r["file"]: (r["n_rows"], r["n_malformed"]) for r in results.malformed_rows(results.scan_rows(spark, str(tmp_path))).collect()}
    assert found == {"a_results.csv": (3, 2), "d_results.csv": (1, 1)}
