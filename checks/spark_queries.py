"""Every operator as a query over the given tables. Each function takes ``(spark, folder)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.functions import naming, rng, text, vectors
from widetab.operators import (
    boosting, encode, extra_trees, impute, lasso, layout, learn, matrix, metrics, select, split, stats, target,
)
from widetab.operators import reduce as reducers
from widetab.operators.registry import make_reducer
from widetab.plans import experiment, report
from widetab.plans.prepare import prepare
from widetab.sources import results as result_files
from widetab.sources import tables
from widetab.session import cut_lineage

QUERIES = {}
ALL_STATS = 16  # target width used with the 64-wide table


def query(function):
    QUERIES[function.__name__] = function
    return function


def read(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide(spark, folder) -> DataFrame:
    """64 features, 10 classes."""
    return layout.from_array(read(spark, folder, "embeddings"), "embedding", F.col("label"), "vec_id")


def wide_regression(spark, folder) -> DataFrame:
    """Element 0 is the target, the other 63 are features."""
    values = F.col("embedding").cast("array<double>")
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.get(values, F.lit(0)).alias("label"), F.slice(values, 2, 63).alias("features")
    )


def wide_binary(spark, folder) -> DataFrame:
    """Labelled documents as a mixed table: counts of the whole text, language and source.

    Fits read a table several times, so they take it from a checkpoint instead of parsing texts again.
    """
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    body = F.col("text")
    counts = docs.select(
        F.col("doc_id").alias("row_id"), "n_chars",
        F.size(F.split(body, r"\s+")).alias("n_words"), F.size(F.split(body, "\n")).alias("n_lines"),
        F.length(F.regexp_replace(body, r"[^0-9]", "")).alias("n_digits"),
        F.length(F.regexp_replace(body, r"[^.,;:!?]", "")).alias("n_marks"), "lang", "source",
    )
    return counts.join(labels.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label")), "row_id")


def encoded_binary(spark, folder) -> DataFrame:
    table = cut_lineage(wide_binary(spark, folder))
    return encode.ColumnEncoder().fit(table).transform(table)


def cells(df: DataFrame, *keys: str, value: str = "value", index: str = "feature_idx", digits: int = 6) -> DataFrame:
    """Arrays are compared cell by cell."""
    long = df.select(*keys, F.posexplode("features").alias(index, value))
    return long.withColumn(value, F.round(value, digits))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return reduce(lambda d, n: d.withColumn(n, F.round(n, digits)), names, df)


# --- univariate statistics and selection --------------------------------------------------------


@query
def kbest_scores(spark, folder):
    return rounded(stats.anova_scores(wide(spark, folder)), "score")


@query
def kbest_project(spark, folder):
    df = wide(spark, folder)
    model = make_reducer("kbest_fs", num_features=ALL_STATS).fit(df)
    index = vectors.array_literal(model.indices, "int")
    placed = cells(model.transform(df), "row_id", "label", index="pos")
    return placed.select("row_id", "label", F.get(index, F.col("pos")).alias("feature_idx"), "value")


@query
def kbest_regression_scores(spark, folder):
    return rounded(stats.regression_scores(wide_regression(spark, folder)), "score")


@query
def kbest_fold_scores(spark, folder):
    """Training scores of five folds from one scan: all moments minus those of the fold."""
    df = wide(spark, folder).withColumn("fold", F.pmod("row_id", F.lit(5)).cast("int"))
    moments = stats.training_moments(stats.feature_moments(df, ["fold", "label"]), 5)
    return rounded(stats.anova_from_moments(moments, ["fold"]), "score")


@query
def variance_scores(spark, folder):
    return stats.feature_moments(wide(spark, folder)).select("feature_idx", F.round("var_pop", 9).alias("variance"))


@query
def variance_fs(spark, folder):
    df = wide(spark, folder)
    model = make_reducer("variance_fs", var_threshold=0.984).fit(df)
    index = vectors.array_literal(model.indices, "int")
    return cells(model.transform(df), "row_id", index="pos").select("row_id", F.get(index, F.col("pos")).alias("feature_idx"), "value")


@query
def mean_importance_cut(spark, folder):
    scores = stats.feature_moments(wide(spark, folder)).select("feature_idx", F.col("var_pop").alias("score"))
    return stats.at_least_mean(scores).select("feature_idx", F.col("rank").cast("int").alias("rank"), "selected")


@query
def original(spark, folder):
    df = wide(spark, folder)
    kept = make_reducer("original").fit(df).transform(df)
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return kept.select("row_id", F.size("features").alias("width"), F.round(total, 6).alias("total"))


@query
def random_fs(spark, folder):
    df = wide(spark, folder)
    model = make_reducer("random_fs", num_features=ALL_STATS, seed=7).fit(df)
    index = vectors.array_literal(model.indices, "int")
    return cells(model.transform(df), "row_id", index="pos").withColumn("feature_idx", F.get(index, F.col("pos")))


@query
def column_complement(spark, folder):
    df = wide(spark, folder)
    kept = make_reducer("kbest_fs", num_features=ALL_STATS).fit(df).indices
    rest = vectors.complement(64, kept)
    left = df.withColumn("features", vectors.gather(F.col("features"), rest))
    return left.select("row_id", F.posexplode("features").alias("pos", "value"), rest.alias("rest")).select(
        "row_id", F.get("rest", F.col("pos")).alias("feature_idx"), F.round("value", 6).alias("value")
    )


@query
def standardize_stats(spark, folder):
    return rounded(stats.standard_scales(wide(spark, folder)), "mean", "scale", digits=9)


@query
def lasso_alpha_max(spark, folder):
    return rounded(stats.lasso_alpha_max(wide_regression(spark, folder)), "alpha_max", "alpha", digits=9)


@query
def ensemble_topk(spark, folder):
    scores = select.view_scores(wide(spark, folder), 4, 11)
    return rounded(select.ensemble_topk(scores, ALL_STATS), "score")


@query
def lasso_fs(spark, folder):
    df = wide_regression(spark, folder)
    model = make_reducer("lasso_fs", num_features=ALL_STATS, task_type="regression").fit(df)
    return model.report.withColumn("score", F.round("score", 4))


@query
def lasso_optimal(spark, folder):
    """Optimality conditions of the L1 model at every feature, over all rows.

    The residual's covariance with a standardised feature is the penalty for a used feature and at most
    the penalty for an unused one.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    df = wide_regression(spark, folder)
    alpha = stats.lasso_alpha_max(df).first()["alpha"]
    scales = stats.standard_scales(df).orderBy("feature_idx").collect()
    z = vectors.standardize(F.col("features"), [r["mean"] for r in scales], [r["scale"] for r in scales])
    rows = df.select(z.alias("features"), array_to_vector(z).alias("v"), "label")
    model = LinearRegression(featuresCol="v", regParam=alpha, elasticNetParam=1.0, standardization=False, tol=1e-9, maxIter=3000).fit(rows)
    weight = vectors.array_literal(model.coefficients.toArray())
    residuals = model.transform(rows).select("features", (F.col("label") - F.col("prediction")).alias("residual"))
    slopes = layout.to_long(residuals, ("residual",)).groupBy("feature_idx").agg(F.covar_pop("value", "residual").alias("g"))
    used = F.get(weight, F.col("feature_idx"))
    excess = F.when(used == 0, F.greatest(F.abs("g") - F.lit(alpha), F.lit(0.0))).otherwise(F.abs(F.col("g") - F.signum(used) * F.lit(alpha)))
    return slopes.select("feature_idx", (excess <= 1e-4 * alpha).alias("optimal"))


@query
def lasso_fold_coefficients(spark, folder):
    """L1 coefficients of five folds, all from one Gram pass."""
    df = wide_regression(spark, folder).withColumn("fold", F.pmod("row_id", F.lit(5)).cast("int"))
    return lasso.coefficient_table(df, 5).withColumn("coefficient", F.round("coefficient", 6) + 0.0)


@query
def lasso_fs_classes(spark, folder):
    df = encoded_binary(spark, folder)
    return make_reducer("lasso_fs", num_features=3, task_type="binary").fit(df).report.withColumn("score", F.round("score", 4))


@query
def tree_fs(spark, folder):
    return make_reducer("tree_fs", seed=3).fit(wide(spark, folder)).report.withColumn("score", F.round("score", 6))


@query
def sand_fs(spark, folder):
    df = wide(spark, folder)
    model = make_reducer("sand_fs", num_features=ALL_STATS, seed=5).fit(df)
    return model.report.withColumn("score", F.round("score", 4))


# --- matrices and reductions --------------------------------------------------------------------


@query
def covariance(spark, folder):
    return rounded(matrix.covariance(wide(spark, folder)), "cov_pop", digits=8)


@query
def feature_distances(spark, folder):
    return rounded(matrix.squared_distances(wide(spark, folder)), "dist2")


@query
def pca_rotation(spark, folder):
    """With all components PCA is a rotation: row norms equal those of the centred rows."""
    df = wide(spark, folder)
    turned = make_reducer("pca_dr", num_features=64).fit(df).transform(df)
    norm = F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)
    return turned.select("row_id", F.round(norm, 6).alias("norm2"))


@query
def pca_total_variance(spark, folder):
    """The explained variances of all components add up to the variance of the features."""
    df = wide(spark, folder)
    model = make_reducer("pca_dr", num_features=64).fit(df)
    projected = stats.feature_moments(model.transform(df))
    return projected.agg(F.round(F.sum("var_pop"), 6).alias("total_variance"), F.count(F.lit(1)).alias("components"))


@query
def pca_uncorrelated(spark, folder):
    """Different components are uncorrelated over all rows, and their variances descend."""
    df = wide(spark, folder)
    projected = make_reducer("pca_dr", num_features=ALL_STATS).fit(df).transform(df)
    cov = matrix.covariance(projected)
    variances = cov.filter("i = j").select(F.col("i").alias("v"), F.col("cov_pop").alias("var"))
    pairs = cov.filter("i < j").join(variances.withColumnsRenamed({"v": "i", "var": "vi"}), "i").join(variances.withColumnsRenamed({"v": "j", "var": "vj"}), "j")
    return pairs.select("i", "j", (F.abs("cov_pop") < 1e-9).alias("uncorrelated"), (F.col("vi") >= F.col("vj")).alias("descending"))


def very_wide(spark, folder) -> DataFrame:
    """6,000 features, each a mixture of two of the 64. Built by numpy: array functions of Spark take about 15 ms for such a row."""
    j = np.arange(6000)
    first, second = j % 64, (j * 5 + 3) % 64
    by_first, by_second = 1.0 + (j % 7) / 10.0, (j % 11) / 10.0 - 0.5

    def mixed(batches):
        for batch in batches:
            e = matrix.batch_matrix(batch.column(2), 64)
            for piece in matrix.row_pieces(len(e), len(j)):
                x = e[piece][:, first] * by_first + e[piece][:, second] * by_second
                own = batch.slice(piece.start, piece.stop - piece.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), matrix.list_column(x)], names=["row_id", "label", "features"])

    narrow = read(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return narrow.mapInArrow(mixed, narrow.schema)


@query
def pca_very_wide(spark, folder):
    """All 64 components that 6,000 features have, without their covariance matrix: trace and squared norm of that matrix."""
    df = cut_lineage(very_wide(spark, folder))
    model = make_reducer("pca_dr", num_features=64).fit(df)
    values = [float(v) for v in model.variance]
    return spark.createDataFrame([(len(values), round(sum(values), 5), round(sum(v * v for v in values), 5))], "components int, total double, squares double")


@query
def pca_residuals(spark, folder):
    """Axes of 6,000 features from the rows alone: the covariance times an axis is the axis times its variance."""
    df = cut_lineage(very_wide(spark, folder))
    model = make_reducer("pca_dr", num_features=8).fit(df)
    n, means, _ = matrix.column_moments(df)
    image = matrix.normal_equations_pass(df, model.components, means) / (n - 1)
    rest = ((image - model.components * model.variance) ** 2).sum(axis=0) ** 0.5
    return spark.createDataFrame([(i, bool(r <= 1e-6 * model.variance[0])) for i, r in enumerate(rest)], "component int, within boolean")


@query
def pca_explained(spark, folder):
    """Variance of every component, measured on the projected rows."""
    df = wide(spark, folder)
    model = make_reducer("pca_dr", num_features=ALL_STATS).fit(df)
    return stats.feature_moments(model.transform(df)).select(F.col("feature_idx").alias("component"), F.round("var_pop", 6).alias("variance"))


@query
def pca_project(spark, folder):
    df = wide(spark, folder)
    return cells(make_reducer("pca_dr", num_features=8).fit(df).transform(df), "row_id", index="component")


@query
def kbest_pca(spark, folder):
    """16 selected features, and all components of the other 48, which keep their centred norm."""
    df = wide(spark, folder)
    model = make_reducer("kbest+pca", num_kbest_features=16, num_pca_comps=48).fit(df)
    out = model.transform(df)
    kept = F.aggregate(F.slice("features", 1, 16), F.lit(0.0), lambda a, v: a + v)
    norm = F.aggregate(F.slice("features", 17, 48), F.lit(0.0), lambda a, v: a + v * v)
    return out.select("row_id", F.size("features").alias("width"), F.round(kept, 6).alias("kept_sum"), F.round(norm, 6).alias("rest_norm2"))


@query
def random_projection(spark, folder):
    df = wide(spark, folder)
    return cells(make_reducer("random_dr", num_features=8, seed=13).fit(df).transform(df), "row_id", index="component")


@query
def agglo_pool(spark, folder):
    groups = [list(range(i, i + 8)) for i in range(0, 64, 8)]
    df = wide(spark, folder).withColumn("features", vectors.pool(F.col("features"), groups))
    return cells(df, "row_id", index="cluster")


@query
def agglo_dr(spark, folder):
    df = wide(spark, folder)
    return cells(make_reducer("agglo_dr", num_features=8).fit(df).transform(df), "row_id", index="cluster")


@query
def agglo_clusters(spark, folder):
    """Every feature is in exactly one of the clusters."""
    clusters = make_reducer("agglo_dr", num_features=8).fit(wide(spark, folder)).clusters
    rows = [(c, i) for c, members in enumerate(clusters) for i in members]
    members = spark.createDataFrame(rows, "cluster int, feature_idx int")
    seen = layout.to_long(wide(spark, folder), ()).groupBy("feature_idx").agg(F.count("value").alias("cells"))
    return seen.join(members, "feature_idx", "left").groupBy("feature_idx", "cells").agg(F.count("cluster").alias("clusters"))


@query
def rbf_landmarks(spark, folder):
    """Kernel of every row against 16 landmark rows."""
    df = wide(spark, folder)
    table = reducers.choose_landmarks(df, 16, 17).toArrow()
    z = matrix.batch_matrix(table.column("features"), 64)
    import numpy as np

    kernel = matrix.kernel_project(df.select("row_id", "features"), z, 1.0 / 64, np.eye(16), np.zeros(16))
    return cells(kernel, "row_id", index="landmark")


@query
def kernel_pivots(spark, folder):
    """The first three pivots of the kernel's Cholesky factor, and the share of the centred kernel that is left."""
    marks, residual = reducers.kernel_landmarks(wide(spark, folder), 1.0 / 64, 1.0, limit=3, slack=1.0)
    return spark.createDataFrame([(i, int(r), round(residual, 8)) for i, r in enumerate(marks.ids)], "position int, row_id bigint, residual double")


@query
def kpca_project(spark, folder):
    df = wide(spark, folder)
    return cells(make_reducer("kpca_dr", num_features=4).fit(df).transform(df), "row_id", index="component")


@query
def kpca_residual(spark, folder):
    """What the landmarks of the default share leave of each row's kernel with itself, over all rows."""
    df = wide(spark, folder)
    model = make_reducer("kpca_dr", num_features=4).fit(df)
    return spark.createDataFrame([(model.residual <= 0.01, len(model.landmarks) < df.count(), bool((model.variance[:-1] >= model.variance[1:]).all()))], "reached boolean, fewer boolean, descending boolean")


# --- row-local functions on features ------------------------------------------------------------


@query
def nonfinite_clean(spark, folder):
    spoil = lambda v: F.when(v > 0.2, F.lit(float("nan"))).when(v < -0.2, F.lit(float("-inf"))).when(v > 0.15, F.lit(None)).otherwise(v)
    df = wide(spark, folder).withColumn("features", F.transform("features", spoil))
    return cells(df.withColumn("features", vectors.clean_nonfinite(F.col("features"))), "row_id")


@query
def zero_var_jitter(spark, folder):
    df = wide(spark, folder).withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    marked = df.withColumn("part", F.when(rng.hash52(3, F.col("row_id")) % 10 < 7, "train").otherwise("test"))
    return cells(stats.break_constant(marked, 1e-6, 19, "part"), "row_id", "part", digits=10)


@query
def gate_project(spark, folder):
    df = wide(spark, folder)
    return cells(df.withColumn("features", vectors.project_gate(F.col("features"), 16)), "row_id", value="weight")


@query
def noise_gate(spark, folder):
    df = wide(spark, folder)
    noise = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: rng.normal(23, F.col("row_id"), j))
    weights = vectors.project_gate(F.col("features"), 16)
    return cells(df.withColumn("features", vectors.noise_gate(F.col("features"), weights, noise, 1.5)), "row_id")


@query
def hash_random(spark, folder):
    key = F.col("o_orderkey")
    return read(spark, folder, "orders").select(
        "o_orderkey", F.round(rng.uniform(29, key), 9).alias("u"), F.round(rng.normal(29, key), 6).alias("z")
    )


@query
def md5_bucket(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", rng.md5_bucket(F.col("c_name"), 10).alias("bucket"))


@query
def score_with(spark, folder):
    """A user's own predictor on all rows."""
    scored = learn.score_with(wide(spark, folder), lambda x: x[:, :32].sum(axis=1) - x[:, 32:].sum(axis=1))
    return scored.select("row_id", F.round("prediction", 6).alias("prediction"))


# --- missing values, encoding, types ------------------------------------------------------------


def gappy_lineitem(spark, folder) -> DataFrame:
    """Line items with missing cells; ``empty_*`` columns have no value at all."""
    df = read(spark, folder, "lineitem")
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
        "l_quantity", F.nullif("l_discount", F.lit(0.05)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"),
        F.lit(None).cast("double").alias("empty_number"), F.lit(None).cast("string").alias("empty_text"),
    )


@query
def null_count(spark, folder):
    return stats.missing_cells(gappy_lineitem(spark, folder))


@query
def impute_mean(spark, folder):
    return rounded(stats.column_means(gappy_lineitem(spark, folder)), "mean", digits=9)


@query
def impute_mode(spark, folder):
    df = gappy_lineitem(spark, folder)
    return stats.column_modes(df, [c for c in layout.columns_by_type(df, "string") if c != "row_key"])


@query
def impute_apply(spark, folder):
    df = gappy_lineitem(spark, folder)
    columns = [c for c in df.columns if c != "row_key"]
    filled = impute.ColumnImputer(columns).fit(df).transform(df)
    return rounded(filled, "l_discount", "l_tax")


@query
def impute_features(spark, folder):
    df = wide(spark, folder).withColumn("features", F.transform("features", lambda v: F.when(v < 0.1, v)))
    return cells(impute.FeatureImputer().fit(df).transform(df), "row_id")


def mixed_orders(spark, folder) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("label"), "o_orderpriority", "o_totalprice",
        F.col("o_totalprice").alias("price_again"), F.lit("x").alias("constant"), (F.col("o_totalprice") > 250000).alias("expensive"),
        F.when(F.col("o_custkey") % 2 == 0, 3).otherwise(7).alias("parity"), "o_orderdate",
    )


@query
def encode_columns(spark, folder):
    df = mixed_orders(spark, folder)
    model = encode.ColumnEncoder().fit(df)
    names = F.array(*[F.lit(n) for n in model.names_out])
    out = model.transform(df).select("row_id", F.posexplode("features").alias("pos", "value"))
    return out.select("row_id", F.get(names, F.col("pos")).alias("feature"), F.round("value", 2).alias("value"))


@query
def encode_many_categories(spark, folder):
    """A column with more categories than fit into the plan: its code table is joined."""
    df = read(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment")
    model = encode.ColumnEncoder(label=None).fit(df)
    out = model.transform(df)
    return out.select("row_id", F.get("features", F.lit(0)).cast("int").alias("name_code"), F.get("features", F.lit(1)).cast("int").alias("segment_code"))


@query
def dropped_columns(spark, folder):
    model = encode.ColumnEncoder().fit(mixed_orders(spark, folder))
    rows = [(c, "constant") for c in model.constant] + [(c, f"same as {k}") for c, k in model.duplicates.items()]
    return spark.createDataFrame(rows, "column string, reason string")


@query
def category_to_string(spark, folder):
    return layout.as_text(read(spark, folder, "part").select("p_partkey", "p_size", "p_brand"), ["p_size", "p_brand"])


@query
def label_codes(spark, folder):
    df = read(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("label"))
    return encode.LabelCoder(out="class_id").fit(df).transform(df)


@query
def label_codes_text(spark, folder):
    df = read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    return encode.LabelCoder(out="class_id").fit(df).transform(df)


@query
def sorted_distinct(spark, folder):
    """Distinct labels with their codes."""
    labels = read(spark, folder, "lineitem").select(F.lit("l_suppkey").alias("column"), F.format_string("%06d", "l_suppkey").alias("value"))
    counted = labels.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return encode.sorted_codes(counted)


@query
def task_type(spark, folder):
    found = []
    for table, column in (("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"), ("part", "p_brand"), ("part", "p_size"), ("orders", "o_totalprice")):
        df = read(spark, folder, table)
        numeric = column in layout.columns_by_type(df, "number")
        one = stats.label_summary(df.select(F.col(column).alias("label")))
        found.append(one.select(F.lit(column).alias("label"), "n_classes", stats.task_type_column(F.col("n_classes"), numeric).alias("task_type")))
    return reduce(DataFrame.unionByName, found)


@query
def task_type_text(spark, folder):
    """Task type from a published description and a number of classes."""
    kinds = ["Supervised Classification", "Supervised Regression", "Learning Curve", "Data Stream classification"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, folder, "part").select("p_partkey", naming.task_type_from_text(kind, F.col("p_size") % 3 + 1).alias("task_type"))


@query
def missing_label_class(spark, folder):
    df = read(spark, folder, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("label"))
    return stats.label_summary(df)


# --- sources and splits -------------------------------------------------------------------------


@query
def train_test_union(spark, folder):
    train = read(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    test = read(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return tables.append_test(train, test)


@query
def boundary_split(spark, folder):
    parts = split.boundary_split(train_test_union(spark, folder))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query
def target_split(spark, folder):
    df = read(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("target"))
    arrays, _ = tables.split_target(df, "target", "c_custkey")
    return cells(arrays, "row_id", "label")


def published_splits(spark, folder) -> DataFrame:
    """Two repeats of three folds over the wide table."""
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"))
    planned = split.schedule(rows, 2, 3)
    is_test = rng.hash52(F.col("repeat"), F.col("row_id")) % 3 == F.col("fold")
    return planned.select("row_id", "repeat", "fold", F.when(is_test, "test").otherwise("train").alias("part"))


@query
def published_split_join(spark, folder):
    joined = split.published_parts(wide(spark, folder), published_splits(spark, folder))
    return joined.groupBy("repeat", "fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("features", F.lit(0))), 6).alias("mean0")
    )


@query
def published_split_part(spark, folder):
    kept = split.published_part(wide(spark, folder), published_splits(spark, folder), 1, 2, "test")
    return kept.select("row_id", "label")


@query
def catalog_lookup(spark, folder):
    datasets = read(spark, folder, "part").select(F.col("p_partkey").alias("dataset_id"), F.col("p_brand").alias("name"))
    tasks = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("dataset_id"))
    return tables.first_tasks(datasets, tasks)


def labelled_orders(spark, folder) -> DataFrame:
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))


@query
def holdout_stratified(spark, folder):
    return split.holdout(labelled_orders(spark, folder), 0.3, 31, "label")


@query
def holdout_plain(spark, folder):
    return split.holdout(labelled_orders(spark, folder), 0.3, 31).select("row_id", "part")


@query
def kfold_assign(spark, folder):
    return split.kfold(labelled_orders(spark, folder), 8, 37, "label")


@query
def strat_chunks(spark, folder):
    return split.chunks(labelled_orders(spark, folder), 256, 41, "label")


@query
def chunk_split(spark, folder):
    chunked = split.chunks(labelled_orders(spark, folder), 256, 41, "label")
    return split.chunk_holdout(chunked, 0.3, 43)


@query
def chunk_coverage(spark, folder):
    """Chunks of line items by order, whose two parts need not see the same classes."""
    parts = read(spark, folder, "lineitem").select(
        F.floor(F.col("l_orderkey") / 16).alias("chunk"), F.col("l_returnflag").alias("label"),
        F.when(F.col("l_linenumber") > 4, "test").otherwise("train").alias("part"),
    )
    return split.class_coverage(parts)


@query
def ordered_split(spark, folder):
    df = read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"))
    return split.ordered_split(df, 0.8)


@query
def seed_schedule(spark, folder):
    datasets = read(spark, folder, "part").select(F.col("p_name").alias("dataset")).distinct()
    return split.schedule(datasets, 10, 3, 42)


# --- scores -------------------------------------------------------------------------------------


@query
def rmse(spark, folder):
    df = read(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return rounded(metrics.rmse(df), "rmse", "norm_rmse")


@query
def roc_auc(spark, folder):
    df = wide_binary(spark, folder).select("label", F.log(F.col("n_chars") + 1.0).alias("score"))
    return rounded(metrics.roc_auc(df), "roc_auc", digits=9)


@query
def roc_auc_ties(spark, folder):
    """Many equal scores, and prefix sums over several score ranges."""
    df = read(spark, folder, "lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("label"), F.col("l_quantity").alias("score"))
    return rounded(metrics.roc_auc(df, rows_per_bucket=8), "roc_auc", digits=9)


@query
def log_loss(spark, folder):
    """Three classes with probabilities from quantity and discount."""
    a, b = F.col("l_quantity") / 60.0, F.col("l_discount") * 1.5
    p = F.array(a * (1 - b), (1 - a) * (1 - b), b)
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rounded(metrics.log_loss(read(spark, folder, "lineitem").select(label.alias("label"), p.alias("probability"))), "log_loss")


@query
def ordered_split_text(spark, folder):
    """Text ids, narrowed by text pivots down to ranges of 200 rows."""
    df = read(spark, folder, "customer").select(F.col("c_name").alias("row_id"))
    return split.ordered_split(df, 0.8, leaf=200)


@query
def ordered_split_large_ids(spark, folder):
    """Ids that a double cannot tell apart."""
    df = read(spark, folder, "orders").select((F.lit(1 << 60) + F.col("o_orderkey")).alias("row_id"))
    return split.ordered_split(df, 0.3, leaf=500)


@query
def roc_auc_many_ranges(spark, folder):
    """Prefix sums over some hundred ranges of distinct scores."""
    df = read(spark, folder, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("score"))
    return rounded(metrics.roc_auc(df, rows_per_bucket=64), "roc_auc", digits=9)


@query
def encode_skewed_categories(spark, folder):
    """Two columns with thousands of categories; half of the rows share one value of the first."""
    text = F.when(F.col("o_orderkey") % 2 == 0, "always").otherwise(F.concat(F.lit("c"), F.col("o_orderkey")))
    df = read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit(0).alias("label"), text.alias("a"), F.concat(F.lit("k"), F.col("o_custkey")).alias("b"))
    out = encode.ColumnEncoder().fit(df).transform(df)
    return out.select("row_id", F.get("features", F.lit(0)).cast("int").alias("a"), F.get("features", F.lit(1)).cast("int").alias("b"))


# --- trees --------------------------------------------------------------------------------------


@query
def tree_root_splits(spark, folder):
    """First split of ten extremely randomised trees: hashed candidates and cuts, largest decrease of impurity."""
    found = extra_trees.root_splits(wide(spark, folder), trees=10, seed=3)
    return found.select("tree", "feature_idx", F.round("threshold", 9).alias("threshold"), F.round("decrease", 6).alias("decrease"), "left_rows")


@query
def boosted_split(spark, folder):
    """One split over ten classes: its place and the leaf values of every class."""
    model = boosting.HistogramBoosting("multiclass", 10, maxIter=1, maxDepth=1, validation=0.0).fit(wide(spark, folder))
    tree = model.trees[0]
    feature = int(tree.feature[0])
    rows = [(c, feature, float(model.cuts[feature][tree.bin[0]]), float(tree.value[1, c]), float(tree.value[2, c])) for c in range(10)]
    return rounded(spark.createDataFrame(rows, "label int, feature_idx int, threshold double, left_value double, right_value double"), "threshold", "left_value", "right_value")


def ruled_lines(spark, folder) -> DataFrame:
    """Three classes by a rule in which no column tells anything alone."""
    many, dear, taxed = F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    label = (many != dear).cast("int") + (many & taxed).cast("int")
    return read(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), label.alias("label"), (F.col("l_orderkey") % 4 == 0).alias("held_out"),
        F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")], F.month("l_shipdate").cast("double")).alias("features"),
    )


@query
def boosted_rule(spark, folder):
    """Interactions of three columns are learned from three quarters of the orders and found in the rest."""
    lines = ruled_lines(spark, folder)
    model = learn.make_learner("gbt", task_type="multiclass", classes=3).fit(lines.filter("not held_out"))
    out = model.predict(lines.filter("held_out"))
    return out.groupBy("label", F.col("prediction").cast("int").alias("prediction")).count().withColumnRenamed("count", "n")


def category_orders(spark, folder) -> DataFrame:
    """Two category columns, one with a value that half of all rows hold, and three classes."""
    customer = F.when(F.col("o_orderkey") % 2 == 0, 7).otherwise(F.col("o_custkey") % 50).cast("double")
    priority = F.substring("o_orderpriority", 1, 1).cast("double")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), label.alias("label"), F.array(customer, priority).alias("features"))


@query
def target_statistics(spark, folder):
    """Ordered target statistics of all rows, the order cut into buckets of about 256 rows."""
    df = category_orders(spark, folder)
    found = target.TargetEncoder([0, 1], "multiclass", 3, seed=61).fit(df).ordered(df, rows_per_bucket=256)
    return found.select("row_id", "feature_idx", F.posexplode("mean").alias("label", "mean")).withColumn("mean", F.round("mean", 6))


# --- learners and experiments -------------------------------------------------------------------


@query
def oof_logistic(spark, folder):
    bagged = learn.bag(encoded_binary(spark, folder), learn.make_learner("linear", task_type="binary", classes=2), task_type="binary", mode="mean")
    return bagged.oof.select("row_id", "label", "fold", F.round(F.get("probability", F.lit(1)), 4).alias("p1"))


@query
def oof_coverage(spark, folder):
    """Out-of-fold predictions cover every labelled order once, in the fold the row belongs to."""
    df = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.array(F.col("o_totalprice") / 1e5, F.month("o_orderdate").cast("double")).alias("features"),
    )
    learner = learn.make_learner("linear", task_type="binary", classes=2)
    bagged = learn.bag(df, learner, task_type="binary", seed=53, mode="mean")
    return bagged.oof.select("row_id", "label", "fold", F.size("probability").alias("classes"))


@query
def gbt_oof(spark, folder):
    """Boosted trees on eight features chosen inside each of eight folds, everything from the same scans."""
    learner = learn.make_learner("gbt", task_type="regression")
    reducer = make_reducer("kbest_fs", num_features=8, task_type="regression")
    bagged = learn.bag(wide_regression(spark, folder), learner, reducer, task_type="regression")
    return bagged.oof.select("row_id", "fold", F.round("label", 6).alias("label"), F.round("prediction", 6).alias("prediction"))


@query
def prepared_parts(spark, folder):
    """Impute, encode and narrow one split of the mixed table."""
    table = split.holdout(cut_lineage(wide_binary(spark, folder)), 0.3, 47, "label")
    train, test = (table.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    prepared = prepare(train, test, "binary", reducer=make_reducer("kbest_fs", num_features=4, task_type="binary"))
    marked = prepared.train.withColumn("part", F.lit("train")).unionByName(prepared.test.withColumn("part", F.lit("test")))
    return marked.select("row_id", "label", "part", F.size("features").alias("width"))


@query
def experiment_run(spark, folder):
    exp = experiment.Experiment(
        "documents", model="linear", methods=("original", "kbest_fs", "pca_dr"), task_type="binary",
        num_features=3, num_repeats=1, num_folds=1, num_k_folds=3, save_time=False,
    )
    found, _ = experiment.run(cut_lineage(wide_binary(spark, folder)), exp)
    return found.select("dataset_name", "model", "method", "repeat", "fold", "seed", "metric", F.round("score", 4).alias("score"), F.round("val_score", 4).alias("val_score"))


@query
def width_sweep(spark, folder):
    exp = experiment.Experiment(
        "embeddings", model="linear", methods=("random_fs",), task_type="multiclass",
        num_repeats=1, num_folds=2, num_k_folds=2, scope="split", save_time=False,
    )
    found, _ = experiment.width_sweep(wide(spark, folder), exp, (8, 32))
    return rounded(report.width_summary(experiment.metric_columns(found)), "log_loss_mean", "log_loss_std", digits=4)


# --- reports ------------------------------------------------------------------------------------


def results_table(spark, folder) -> DataFrame:
    """Events read as result rows."""
    return read(spark, folder, "events").select(
        F.lit("events").alias("dataset_name"),
        F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("event_type").alias("method"),
        (F.col("event_id") % 10).cast("int").alias("repeat"), (F.col("event_id") % 3).cast("int").alias("fold"),
        (100 * (1 + F.col("user_id") % 14)).cast("int").alias("num_features"), F.col("value").alias("score"),
        (F.col("value") * 0.9).alias("val_score"), (F.col("value") / 10).alias("fold_time"), "event_id", "ts", "user_id", "props",
    )


@query
def method_summary(spark, folder):
    return report.method_summary(results_table(spark, folder))


@query
def width_summary(spark, folder):
    return rounded(report.width_summary(results_table(spark, folder).withColumnRenamed("score", "log_loss")), "log_loss_mean", "log_loss_std")


@query
def width_summary_single_rows(spark, folder):
    """Every width once: the deviation of a single row is 0."""
    df = results_table(spark, folder).select(F.col("event_id").cast("int").alias("num_features"), F.col("score").alias("log_loss"))
    return report.width_summary(df)


@query
def run_summary(spark, folder):
    return rounded(report.run_summary(results_table(spark, folder)), "mean", "std", "val_mean", "val_std")


@query
def model_method_summary(spark, folder):
    df = results_table(spark, folder)
    names = df.select("model").distinct().filter(~F.col("model").endswith("_3")).select(F.col("model").alias("key"), F.upper("model").alias("name"))
    return rounded(report.model_comparison(df, names=names), "mean", "std", "val_mean", "val_std")


@query
def comparison_matrix(spark, folder):
    summary = report.model_comparison(results_table(spark, folder))
    return rounded(report.comparison_matrix(summary, ("click", "view", "error")), "click", "view", "error")


@query
def fold_time_summary(spark, folder):
    return report.fold_times(results_table(spark, folder))


@query
def results_union(spark, folder):
    events = results_table(spark, folder).select("dataset_name", "method", "score")
    orders = read(spark, folder, "orders").select(F.lit("orders").alias("dataset_name"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("score"))
    parts = read(spark, folder, "part").select(F.lit("part").alias("dataset_name"), F.col("p_brand").alias("method"), F.col("p_retailprice").alias("score"))
    return report.method_summary(reduce(DataFrame.unionByName, [events, orders, parts]), by=("dataset_name", "method"))


@query
def coerce_dropna(spark, folder):
    raw = F.when(F.col("user_id") % 3 == 0, "oops").when(F.col("user_id") % 3 == 1, F.format_string("%.2f", "score"))
    return report.numeric_scores(results_table(spark, folder).select("event_id", raw.alias("score")), "score")


@query
def valid_file_filter(spark, folder):
    raw = F.when(F.col("user_id") % 4 == 0, "bad").otherwise(F.format_string("%.2f", "score"))
    rows = results_table(spark, folder).select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("file"), raw.alias("score"))
    return result_files.usable_files(rows, "file", "score")


@query
def results_config_join(spark, folder):
    """Result files and their configurations by shared stem; some configurations are missing or unusable."""
    df = results_table(spark, folder)
    stem = F.concat(F.lit("set"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("_num_features_"), F.col("num_features").cast("string"))).otherwise(""))
    files = df.select(F.concat(stem, F.lit("_results.csv")).alias("file")).distinct()
    configs = df.filter(F.col("user_id") % 3 != 0).select(
        F.concat(stem, F.lit("_config.yaml")).alias("file"), F.when(F.col("user_id") % 5 == 0, "many").otherwise((F.col("user_id") + 7).cast("string")).alias("value")
    ).distinct()
    return result_files.result_widths(files, configs)


@query
def display_name(spark, folder):
    names = read(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")).filter("key < '5'")
    keyed = read(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("model"))
    return naming.display_names(keyed, "model", names)


@query
def slug(spark, folder):
    raw = F.concat(F.lit("-- "), F.upper("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("!"))
    return read(spark, folder, "part").select("p_partkey", text.slug(raw).alias("slug"))


@query
def name_regex(spark, folder):
    name = F.concat(F.col("method"), F.when(F.col("user_id") % 4 == 0, "_other_").otherwise("_num_features_"), F.col("num_features").cast("string"), F.lit("_results.csv"))
    return results_table(spark, folder).select("event_id", text.width_from_name(name).alias("num_features"))


@query
def hyperparam_regex(spark, folder):
    path = F.concat(
        F.lit("/runs/"), F.col("method"), F.when(F.col("user_id") % 4 == 0, "_x").otherwise("_s"), F.col("user_id").cast("string"),
        F.lit("_nf"), F.col("num_features").cast("string"), F.lit("_vt0."), F.format_string("%02d", F.col("event_id") % 100), F.lit("_nte"), F.col("repeat").cast("string"), F.lit("_results.csv"),
    )
    return results_table(spark, folder).select("event_id", text.hyperparams_from_name(path).alias("h")).select("event_id", "h.seed", "h.nf", "h.vt", "h.nte")


@query
def kv_parse(spark, folder):
    lines = read(spark, folder, "orders").select(
        "o_orderkey",
        F.explode(F.array(
            F.concat(F.lit("seed: "), F.col("o_custkey").cast("string")), F.concat(F.lit("  price : "), F.format_string("%.2f", "o_totalprice")),
            F.concat(F.lit("done: "), F.when(F.col("o_orderstatus") == "F", "True").otherwise("false")),
            F.concat(F.lit("priority: "), F.col("o_orderpriority"), F.lit("  ")), F.lit("# no pair here"),
        )).alias("value"),
    )
    return text.parse_key_values(lines).drop("value")


@query
def deep_key_search(spark, folder):
    """``k`` inside nested configurations, or in a list of them, or absent."""
    nested = (
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"run": {"id": 1, "args": '), F.col("props"), F.lit("}}")))
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"steps": [{"name": "a"}, '), F.col("props"), F.lit("]}")))
        .otherwise(F.lit('{"other": {"x": 2}}'))
    )
    return results_table(spark, folder).select("event_id", text.deep_find(nested, "k").try_cast("int").alias("k"))


@query
def run_id(spark, folder):
    df = results_table(spark, folder)
    return df.select("event_id", text.run_id(F.col("dataset_name"), F.col("method"), F.col("num_features"), F.col("ts")).alias("run_id"))


@query
def method_category(spark, folder):
    pool = list(naming.METHOD_NAMES)
    method = F.element_at(F.array(*[F.lit(m) for m in pool]), (F.col("user_id") % len(pool) + 1).cast("int"))
    df = results_table(spark, folder).select("event_id", method.alias("method"))
    return df.select("event_id", "method", naming.method_category(F.col("method")).alias("category"), naming.method_name(F.col("method")).alias("full_name"))


@query
def metric_choice(spark, folder):
    kinds = ["regression", "binary", "multiclass", "ranking"]
    task = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("user_id") % 4 + 1).cast("int"))
    df = results_table(spark, folder).withColumn("metric", naming.metric_for(task))
    return df.select("event_id", "metric", naming.learner_metric(F.col("metric")).alias("learner_metric"), naming.positive_score(F.col("metric"), F.col("score")).alias("score"))


@query
def budget_split(spark, folder):
    selected, projected = naming.split_budget_columns(F.col("user_id"), 0.75)
    return results_table(spark, folder).select("event_id", selected.alias("k1"), projected.alias("k2"))


@query
def experiment_grid(spark, folder):
    named = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("csv:/data/"), F.col("p_size").cast("string"))).otherwise("hiva")
    datasets = read(spark, folder, "part").select(named.alias("dataset")).distinct()
    return experiment.grid(datasets, ["gbt", "linear"], ["original", "kbest_fs", "pca_dr"], {"hiva": "363677"})
