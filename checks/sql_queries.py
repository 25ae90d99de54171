"""SQL counterparts of the registered queries, written independently of the Spark code.

Class moments are computed in two passes over the cells, ranks by plain window functions, projections
by joins: slow at scale, but easy to check.
"""

from __future__ import annotations


def h(text: str) -> str:
    """First 13 hexadecimal digits of the md5 of a text expression, as an integer."""
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def u(text: str) -> str:
    return f"({h(text)} / 4503599627370496.0)"


def z(text: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u(text + chr(124) * 2 + chr(39) + ':r' + chr(39))})) * cos(2.0 * pi() * {u(text + chr(124) * 2 + chr(39) + ':a' + chr(39))}))"


CELLS = """cells AS (
  SELECT vec_id AS row_id, label, (generate_subscripts(embedding, 1) - 1)::INTEGER AS feature_idx, unnest(embedding)::DOUBLE AS v
  FROM embeddings)"""

REG = """wide AS (
  SELECT vec_id AS row_id, (generate_subscripts(embedding, 1) - 2)::INTEGER AS feature_idx, unnest(embedding)::DOUBLE AS v,
         embedding[1]::DOUBLE AS y FROM embeddings),
reg AS (SELECT * FROM wide WHERE feature_idx >= 0)"""

ANOVA = CELLS + """,
means AS (SELECT feature_idx, label, count(*) AS n, avg(v) AS m FROM cells GROUP BY 1, 2),
grand AS (SELECT feature_idx, avg(v) AS g FROM cells GROUP BY 1),
within AS (SELECT feature_idx, sum((v - m) * (v - m)) AS w, count(*) AS n FROM cells JOIN means USING (feature_idx, label) GROUP BY 1),
between_ AS (SELECT feature_idx, sum(n * (m - g) * (m - g)) AS b, count(*) AS c FROM means JOIN grand USING (feature_idx) GROUP BY 1),
scores AS (SELECT feature_idx, (b / (c - 1)) / (w / (n - c)) AS score FROM within JOIN between_ USING (feature_idx)),
best AS (SELECT feature_idx FROM scores ORDER BY score DESC, feature_idx LIMIT 16)"""

SQL: dict[str, str] = {}

# --- univariate statistics and selection

SQL["kbest_scores"] = f"WITH {ANOVA} SELECT feature_idx, round(score, 6) AS score FROM scores"

SQL["kbest_project"] = f"""WITH {ANOVA}
SELECT row_id, label, feature_idx, round(v, 6) AS value FROM cells JOIN best USING (feature_idx)"""

SQL["kbest_regression_scores"] = f"""WITH {REG}, r AS (SELECT feature_idx, corr(v, y) AS r, count(*) AS n FROM reg GROUP BY 1)
SELECT feature_idx, round(r * r / (1 - r * r) * (n - 2), 6) AS score FROM r"""

SQL["kbest_fold_scores"] = """WITH cells AS (
  SELECT f.fold::INTEGER AS fold, vec_id % 5 AS own, label, (generate_subscripts(embedding, 1) - 1)::INTEGER AS feature_idx, unnest(embedding)::DOUBLE AS v
  FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f),
train AS (SELECT * FROM cells WHERE own <> fold),
means AS (SELECT fold, feature_idx, label, count(*) AS n, avg(v) AS m FROM train GROUP BY ALL),
grand AS (SELECT fold, feature_idx, avg(v) AS g FROM train GROUP BY ALL),
w AS (SELECT fold, feature_idx, sum((v - m) ** 2) AS w, count(*) AS n FROM train JOIN means USING (fold, feature_idx, label) GROUP BY ALL),
b AS (SELECT fold, feature_idx, sum(n * (m - g) ** 2) AS b, count(*) AS c FROM means JOIN grand USING (fold, feature_idx) GROUP BY ALL)
SELECT fold, feature_idx, round((b / (c - 1)) / (w / (n - c)), 6) AS score FROM w JOIN b USING (fold, feature_idx)"""

SQL["variance_scores"] = f"WITH {CELLS} SELECT feature_idx, round(var_pop(v), 9) AS variance FROM cells GROUP BY 1"

SQL["variance_fs"] = f"""WITH {CELLS}, kept AS (SELECT feature_idx FROM cells GROUP BY 1 HAVING var_pop(v) > 0.984 * (1 - 0.984))
SELECT row_id, feature_idx, round(v, 6) AS value FROM cells JOIN kept USING (feature_idx)"""

SQL["mean_importance_cut"] = f"""WITH {CELLS}, s AS (SELECT feature_idx, var_pop(v) AS score FROM cells GROUP BY 1)
SELECT feature_idx, (row_number() OVER (ORDER BY score DESC, feature_idx))::INTEGER AS rank, score >= (SELECT avg(score) FROM s) AS selected FROM s"""

SQL["original"] = f"WITH {CELLS} SELECT row_id, count(*)::INTEGER AS width, round(sum(v), 6) AS total FROM cells GROUP BY 1"

SQL["random_fs"] = f"""WITH {CELLS},
drawn AS (SELECT feature_idx, (row_number() OVER (ORDER BY {h("'7:' || feature_idx")}, feature_idx) - 1)::INTEGER AS pos FROM (SELECT DISTINCT feature_idx FROM cells))
SELECT row_id, pos, feature_idx, round(v, 6) AS value FROM cells JOIN drawn USING (feature_idx) WHERE pos < 16"""

SQL["column_complement"] = f"""WITH {ANOVA}
SELECT row_id, feature_idx, round(v, 6) AS value FROM cells WHERE feature_idx NOT IN (SELECT feature_idx FROM best)"""

SQL["standardize_stats"] = f"""WITH {CELLS}
SELECT feature_idx, round(avg(v), 9) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 9) AS scale FROM cells GROUP BY 1"""

SQL["lasso_alpha_max"] = f"""WITH {REG},
m AS (SELECT feature_idx, avg(v) AS mv, stddev_pop(v) AS sv, avg(y) AS my, count(*) AS n FROM reg GROUP BY 1),
s AS (SELECT feature_idx, abs(sum((v - mv) / sv * (y - my))) / any_value(n) AS a FROM reg JOIN m USING (feature_idx) GROUP BY 1)
SELECT round(max(a), 9) AS alpha_max, round(max(a) * 0.1, 9) AS alpha FROM s"""

SQL["ensemble_topk"] = f"""WITH {CELLS}, viewed AS (
  SELECT x.view_id, c.* FROM cells c, (SELECT unnest([0, 1, 2, 3]) AS view_id) x WHERE {h("'11:' || row_id")} % 4 <> view_id),
means AS (SELECT view_id, feature_idx, label, count(*) AS n, avg(v) AS m FROM viewed GROUP BY ALL),
grand AS (SELECT view_id, feature_idx, avg(v) AS g FROM viewed GROUP BY ALL),
w AS (SELECT view_id, feature_idx, sum((v - m) ** 2) AS w, count(*) AS n FROM viewed JOIN means USING (view_id, feature_idx, label) GROUP BY ALL),
b AS (SELECT view_id, feature_idx, sum(n * (m - g) ** 2) AS b, count(*) AS c FROM means JOIN grand USING (view_id, feature_idx) GROUP BY ALL),
s AS (SELECT feature_idx, avg((b / (c - 1)) / (w / (n - c))) AS score FROM w JOIN b USING (view_id, feature_idx) GROUP BY 1)
SELECT feature_idx, round(score, 6) AS score FROM s ORDER BY s.score DESC, feature_idx LIMIT 16"""

# --- matrices and reductions

SQL["covariance"] = f"""WITH {CELLS}
SELECT a.feature_idx AS i, b.feature_idx AS j, round(covar_pop(a.v, b.v), 8) AS cov_pop
FROM cells a JOIN cells b USING (row_id) WHERE a.feature_idx <= b.feature_idx GROUP BY 1, 2"""

SQL["feature_distances"] = f"""WITH {CELLS}
SELECT a.feature_idx AS i, b.feature_idx AS j, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS dist2
FROM cells a JOIN cells b USING (row_id) WHERE a.feature_idx < b.feature_idx GROUP BY 1, 2"""

SQL["pca_rotation"] = f"""WITH {CELLS}, m AS (SELECT feature_idx, avg(v) AS m FROM cells GROUP BY 1)
SELECT row_id, round(sum((v - m) * (v - m)), 6) AS norm2 FROM cells JOIN m USING (feature_idx) GROUP BY 1"""

SQL["pca_total_variance"] = f"""WITH {CELLS}, s AS (SELECT feature_idx, var_pop(v) AS vp FROM cells GROUP BY 1)
SELECT round(sum(vp), 6) AS total_variance, count(*) AS components FROM s"""

SQL["kbest_pca"] = f"""WITH {ANOVA}, m AS (SELECT feature_idx, avg(v) AS m FROM cells GROUP BY 1),
t AS (SELECT row_id, v, m, feature_idx IN (SELECT feature_idx FROM best) AS kept FROM cells JOIN m USING (feature_idx))
SELECT row_id, count(*)::INTEGER AS width, round(sum(CASE WHEN kept THEN v ELSE 0 END), 6) AS kept_sum,
       round(sum(CASE WHEN kept THEN 0 ELSE (v - m) * (v - m) END), 6) AS rest_norm2 FROM t GROUP BY 1"""

SQL["random_projection"] = f"""WITH {CELLS}, k AS (SELECT unnest(generate_series(0, 7)) AS component),
f AS (SELECT DISTINCT feature_idx FROM cells),
weights AS (SELECT feature_idx, component::INTEGER AS component, {z("'13:' || feature_idx || ':' || component")} / sqrt(8.0) AS w FROM f, k)
SELECT row_id, component, round(sum(v * w), 6) AS value FROM cells JOIN weights USING (feature_idx) GROUP BY 1, 2"""

SQL["agglo_pool"] = f"WITH {CELLS} SELECT row_id, (feature_idx // 8)::INTEGER AS cluster, round(avg(v), 6) AS value FROM cells GROUP BY 1, 2"

SQL["rbf_landmarks"] = f"""WITH {CELLS},
marks AS (SELECT vec_id, (row_number() OVER (ORDER BY {h("'17:' || vec_id")}, vec_id) - 1)::INTEGER AS landmark FROM embeddings QUALIFY landmark < 16),
z AS (SELECT landmark, feature_idx, v AS zv FROM cells JOIN marks ON row_id = vec_id)
SELECT row_id, landmark, round(exp(-sum((v - zv) * (v - zv)) / 64.0), 6) AS value FROM cells JOIN z USING (feature_idx) GROUP BY 1, 2"""

SQL["lasso_optimal"] = f"WITH {REG} SELECT DISTINCT feature_idx, true AS optimal FROM reg"

SQL["pca_uncorrelated"] = """SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, true AS uncorrelated, true AS descending
FROM (SELECT unnest(generate_series(0, 15)) AS i) a, (SELECT unnest(generate_series(0, 15)) AS j) b WHERE a.i < b.j"""

SQL["agglo_clusters"] = f"WITH {CELLS} SELECT feature_idx, count(*) AS cells, 1::BIGINT AS clusters FROM cells GROUP BY 1"

# --- row-local functions on features

SQL["nonfinite_clean"] = f"""WITH {CELLS}
SELECT row_id, feature_idx, round(CASE WHEN v > 0.15 OR v < -0.2 THEN 0.0 ELSE v END, 6) AS value FROM cells"""

SQL["zero_var_jitter"] = f"""WITH {CELLS}, parts AS (SELECT vec_id AS row_id, CASE WHEN {h("'3:' || vec_id")} % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM embeddings),
extra AS (SELECT row_id, 64::INTEGER AS feature_idx, 1.0 + CASE WHEN part = 'train' THEN {z("'19:' || row_id || ':64'")} * 1e-6 ELSE 0 END AS v, part FROM parts)
SELECT row_id, part, feature_idx, round(v, 10) AS value FROM extra
UNION ALL SELECT row_id, part, feature_idx, round(v, 10) AS value FROM cells JOIN parts USING (row_id)"""

GATE = CELLS + """, sq AS (SELECT row_id, sqrt(sum(least(abs(v), 1.0) ** 2)) AS nrm FROM cells GROUP BY 1),
gate AS (SELECT row_id, feature_idx, v, least(abs(v), 1.0) / (nrm + 1e-12) * 4.0 AS w FROM cells JOIN sq USING (row_id))"""

SQL["gate_project"] = f"WITH {GATE} SELECT row_id, feature_idx, round(w, 6) AS weight FROM gate"

SQL["noise_gate"] = f"""WITH {GATE}
SELECT row_id, feature_idx, round(v * w + 1.5 * (1 - abs(w)) * {z("'23:' || row_id || ':' || feature_idx")}, 6) AS value FROM gate"""

SQL["hash_random"] = f"""SELECT o_orderkey, round({u("'29:' || o_orderkey")}, 9) AS u, round({z("'29:' || o_orderkey")}, 6) AS z FROM orders"""

SQL["md5_bucket"] = """SELECT c_custkey, ((('0x' || substr(md5(c_name), 1, 16))::UBIGINT::HUGEINT % 10) * (18446744073709551616::HUGEINT % 10)
  + (('0x' || substr(md5(c_name), 17, 16))::UBIGINT::HUGEINT % 10))::BIGINT % 10 AS bucket FROM customer""".replace("% 10 AS bucket", "% 10 AS b")
SQL["md5_bucket"] = f"SELECT c_custkey, b::INTEGER AS bucket FROM ({SQL['md5_bucket']})"

SQL["score_with"] = f"WITH {CELLS} SELECT row_id, round(sum(CASE WHEN feature_idx < 32 THEN v ELSE -v END), 6) AS prediction FROM cells GROUP BY 1"

# --- missing values, encoding, types

GAPPY = """gappy AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, l_quantity, nullif(l_discount, 0.05::DOUBLE) AS l_discount,
         nullif(l_tax, 0.0::DOUBLE) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus,
         NULL::DOUBLE AS empty_number, NULL::VARCHAR AS empty_text FROM lineitem)"""

SQL["null_count"] = f"""WITH {GAPPY}
SELECT (sum((l_discount IS NULL)::INT) + sum((l_tax IS NULL)::INT) + sum((l_returnflag IS NULL)::INT)
  + sum((l_linestatus IS NULL)::INT) + 2 * count(*))::BIGINT AS missing_cells FROM gappy"""

SQL["impute_mean"] = f"""WITH {GAPPY}
SELECT 'l_quantity' AS "column", round(avg(l_quantity), 9) AS mean FROM gappy
UNION ALL SELECT 'l_discount', round(avg(l_discount), 9) FROM gappy
UNION ALL SELECT 'l_tax', round(avg(l_tax), 9) FROM gappy
UNION ALL SELECT 'empty_number', 0.0"""

MODES = """counted AS (
  SELECT 'l_returnflag' AS c, l_returnflag AS v, count(*) AS n FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM gappy WHERE l_linestatus IS NOT NULL GROUP BY 2),
modes AS (SELECT c, v, n FROM counted QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, v) = 1)"""

SQL["impute_mode"] = f"""WITH {GAPPY}, {MODES}
SELECT c AS "column", v AS mode, n AS count FROM modes UNION ALL SELECT 'empty_text', 'missing', 0"""

SQL["impute_apply"] = f"""WITH {GAPPY}, {MODES}
SELECT row_key, l_quantity, round(coalesce(l_discount, (SELECT avg(l_discount) FROM gappy)), 6) AS l_discount,
  round(coalesce(l_tax, (SELECT avg(l_tax) FROM gappy)), 6) AS l_tax,
  coalesce(l_returnflag, (SELECT v FROM modes WHERE c = 'l_returnflag')) AS l_returnflag,
  coalesce(l_linestatus, (SELECT v FROM modes WHERE c = 'l_linestatus')) AS l_linestatus,
  0.0::DOUBLE AS empty_number, 'missing' AS empty_text FROM gappy"""

SQL["impute_features"] = f"""WITH {CELLS}, m AS (SELECT feature_idx, avg(v) AS m FROM cells WHERE v < 0.1 GROUP BY 1)
SELECT row_id, feature_idx, round(CASE WHEN v < 0.1 THEN v ELSE m END, 6) AS value FROM cells JOIN m USING (feature_idx)"""

SQL["encode_columns"] = """WITH base AS (SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS prio FROM orders)
SELECT o_orderkey AS row_id, 'o_orderpriority' AS feature, prio::DOUBLE AS value FROM base
UNION ALL SELECT o_orderkey, 'o_totalprice', round(o_totalprice, 2) FROM orders
UNION ALL SELECT o_orderkey, 'expensive', (o_totalprice > 250000)::INT::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'parity', (o_custkey % 2)::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate', epoch_us(o_orderdate)::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate.year', year(o_orderdate)::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate.month', month(o_orderdate)::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate.day', day(o_orderdate)::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate.dayofweek', (dayofweek(o_orderdate) + 1)::DOUBLE FROM orders"""

SQL["encode_many_categories"] = """SELECT c_custkey AS row_id, (dense_rank() OVER (ORDER BY c_name) - 1)::INTEGER AS name_code,
  (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS segment_code FROM customer"""

SQL["dropped_columns"] = """WITH base AS (SELECT o_totalprice, o_totalprice AS price_again, 'x' AS constant FROM orders)
SELECT 'price_again' AS "column", 'same as o_totalprice' AS reason FROM base HAVING bool_and(price_again = o_totalprice)
UNION ALL SELECT 'constant', 'constant' FROM base HAVING count(DISTINCT constant) = 1"""

SQL["category_to_string"] = "SELECT p_partkey, p_size::VARCHAR AS p_size, p_brand FROM part"

SQL["label_codes"] = "SELECT p_partkey AS row_id, p_size AS label, (dense_rank() OVER (ORDER BY p_size) - 1)::INTEGER AS class_id FROM part"

SQL["label_codes_text"] = "SELECT o_orderkey AS row_id, o_orderpriority AS label, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS class_id FROM orders"

SQL["sorted_distinct"] = """SELECT 'l_suppkey' AS "column", printf('%06d', l_suppkey) AS value, count(*) AS n,
  (row_number() OVER (ORDER BY l_suppkey) - 1)::INTEGER AS code FROM lineitem GROUP BY l_suppkey"""

SQL["task_type"] = """WITH k AS (
  SELECT 'l_linestatus' AS label, count(DISTINCT l_linestatus) AS n, false AS num FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), false FROM lineitem
  UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), false FROM part
  UNION ALL SELECT 'p_size', count(DISTINCT p_size), true FROM part
  UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), true FROM orders)
SELECT label, n AS n_classes, CASE WHEN n = 2 THEN 'binary' WHEN n BETWEEN 3 AND 19 THEN 'multiclass' WHEN n >= 20 AND num THEN 'regression' END AS task_type FROM k"""

SQL["task_type_text"] = """SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'regression' WHEN 2 THEN NULL
  ELSE CASE WHEN p_size % 3 + 1 > 2 THEN 'multiclass' ELSE 'binary' END END AS task_type FROM part"""

SQL["missing_label_class"] = """SELECT count(DISTINCT nullif(l_returnflag, 'N')) + max((l_returnflag = 'N')::INT) AS n_classes, bool_or(l_returnflag = 'N') AS has_missing FROM lineitem"""

# --- sources and splits

UNION = """both_ AS (
  SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment, false AS is_test FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, NULL, true FROM supplier)"""

SQL["train_test_union"] = f"WITH {UNION} SELECT * FROM both_"

SQL["boundary_split"] = f"WITH {UNION} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(sum(balance), 2) AS balance FROM both_ GROUP BY 1"

SQL["target_split"] = """SELECT c_custkey AS row_id, c_mktsegment AS label, 0::INTEGER AS feature_idx, c_nationkey::DOUBLE AS value FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, 1, round(c_acctbal, 6) FROM customer"""

PUBLISHED = f"""planned AS (SELECT vec_id AS row_id, r.repeat::INTEGER AS repeat, f.fold::INTEGER AS fold, label, embedding[1]::DOUBLE AS e0
  FROM embeddings, (SELECT unnest([0, 1]) AS repeat) r, (SELECT unnest([0, 1, 2]) AS fold) f),
splits AS (SELECT *, CASE WHEN {h("repeat || ':' || row_id")} % 3 = fold THEN 'test' ELSE 'train' END AS part FROM planned)"""

SQL["published_split_join"] = f"WITH {PUBLISHED} SELECT repeat, fold, part, count(*) AS n, round(avg(e0), 6) AS mean0 FROM splits GROUP BY ALL"

SQL["published_split_part"] = f"WITH {PUBLISHED} SELECT row_id, label FROM splits WHERE repeat = 1 AND fold = 2 AND part = 'test'"

SQL["catalog_lookup"] = """WITH d AS (SELECT p_brand AS name, min(p_partkey) AS dataset_id FROM part GROUP BY 1)
SELECT name, dataset_id, (SELECT min(l_orderkey) FROM lineitem WHERE l_partkey = dataset_id) AS task_id FROM d"""

QUOTAS = """sizes AS (SELECT label, count(*) AS c FROM base GROUP BY 1),
whole AS (SELECT sum(c)::BIGINT AS n, ceil(0.3 * sum(c))::BIGINT AS total FROM sizes),
shares AS (SELECT label, floor(total * c / n)::BIGINT AS q, total * c / n - floor(total * c / n) AS rest, total FROM sizes, whole),
quotas AS (SELECT label, q + (row_number() OVER (ORDER BY rest DESC, label) <= total - sum(q) OVER ())::INT AS quota FROM shares)"""

SQL["holdout_stratified"] = f"""WITH base AS (SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders), {QUOTAS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h("'31:' || row_id")}, row_id) AS rn FROM base)
SELECT row_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM ranked JOIN quotas USING (label)"""

SQL["holdout_plain"] = f"""SELECT o_orderkey AS row_id, CASE WHEN row_number() OVER (ORDER BY {h("'31:' || o_orderkey")}, o_orderkey) <= (SELECT ceil(0.3 * count(*)) FROM orders)
  THEN 'test' ELSE 'train' END AS part FROM orders"""


def folds(seed: int, k: str, label: str = "o_orderpriority") -> str:
    """Consecutive blocks of each class, the larger ones first, starting at the fold where the class before stopped."""
    return f"""base AS (SELECT o_orderkey AS row_id, {label} AS label FROM orders),
kk AS (SELECT {k} AS k FROM base),
sizes AS (SELECT label, count(*) AS c, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM base GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h(f"'{seed}:' || row_id")}, row_id) - 1 AS r FROM base),
placed AS (SELECT row_id, label, r, c // k AS small, c % k AS extra, off, k FROM ranked JOIN sizes USING (label), kk),
folded AS (SELECT row_id, label, ((off + CASE WHEN r < extra * (small + 1) THEN r // (small + 1) ELSE extra + (r - extra * (small + 1)) // greatest(small, 1) END) % k)::INTEGER AS fold FROM placed)"""


SQL["kfold_assign"] = f"WITH {folds(37, 'any_value(8)')} SELECT row_id, label, fold FROM folded"

CHUNKS = folds(41, "greatest(2, ceil(count(*) / 256.0))::BIGINT")
SQL["strat_chunks"] = f"WITH {CHUNKS} SELECT row_id, label, fold AS chunk FROM folded"

SQL["chunk_split"] = f"""WITH {CHUNKS}, ch AS (SELECT row_id, label, fold AS chunk FROM folded),
csz AS (SELECT chunk, label, count(*) AS cn FROM ch GROUP BY ALL),
whole AS (SELECT chunk, sum(cn)::BIGINT AS n, ceil(sum(cn) * 0.3)::BIGINT AS total, min(cn) AS least_, count(*) AS classes FROM csz GROUP BY 1),
shares AS (SELECT chunk, label, floor(total * cn / n)::BIGINT AS q, total * cn / n - floor(total * cn / n) AS rest, total FROM csz JOIN whole USING (chunk)),
quotas AS (SELECT chunk, label, q + (row_number() OVER (PARTITION BY chunk ORDER BY rest DESC, label) <= total - sum(q) OVER (PARTITION BY chunk))::INT AS quota FROM shares),
keyed AS (SELECT *, {h("'43:' || row_id")} AS key FROM ch),
rk AS (SELECT *, row_number() OVER (PARTITION BY chunk, label ORDER BY key, row_id) AS rc, row_number() OVER (PARTITION BY chunk ORDER BY key, row_id) AS rp FROM keyed)
SELECT row_id, label, chunk, least_ >= 2 AND total >= classes AND n - total >= classes AS stratified,
  CASE WHEN (CASE WHEN least_ >= 2 AND total >= classes AND n - total >= classes THEN rc <= quota ELSE rp <= total END) THEN 'test' ELSE 'train' END AS part
FROM rk JOIN quotas USING (chunk, label) JOIN whole USING (chunk)"""

SQL["chunk_coverage"] = """SELECT l_orderkey // 16 AS chunk, count(DISTINCT CASE WHEN l_linenumber <= 4 THEN l_returnflag END) AS n_train,
  count(DISTINCT CASE WHEN l_linenumber > 4 THEN l_returnflag END) AS n_test,
  count(DISTINCT CASE WHEN l_linenumber <= 4 THEN l_returnflag END) = count(DISTINCT CASE WHEN l_linenumber > 4 THEN l_returnflag END) AS covered
FROM lineitem GROUP BY 1"""

SQL["ordered_split"] = """SELECT o_orderkey AS row_id, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT floor(0.8 * count(*)) FROM orders) THEN 'train' ELSE 'test' END AS part FROM orders"""

SQL["seed_schedule"] = """SELECT dataset, r.repeat::INTEGER AS repeat, f.fold::INTEGER AS fold, (42 + 100 * r.repeat)::INTEGER AS rep_seed, (42 + 100 * r.repeat + f.fold)::INTEGER AS fold_seed
FROM (SELECT DISTINCT p_name AS dataset FROM part), (SELECT unnest(generate_series(0, 9)) AS repeat) r, (SELECT unnest(generate_series(0, 2)) AS fold) f"""

# --- scores

SQL["rmse"] = """SELECT round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 6) AS rmse,
  round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)) / stddev_pop(l_extendedprice), 6) AS norm_rmse FROM lineitem"""


def auc(source: str) -> str:
    return f"""WITH s AS ({source}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 9) AS roc_auc FROM r"""


SQL["roc_auc"] = auc("SELECT quality AS label, ln(n_chars + 1.0) AS score FROM documents JOIN labels USING (doc_id)")

SQL["roc_auc_ties"] = auc("SELECT (l_returnflag = 'A')::INT AS label, l_quantity AS score FROM lineitem")

SQL["log_loss"] = """WITH p AS (SELECT l_returnflag AS f, l_quantity / 60.0 AS a, l_discount * 1.5 AS b FROM lineitem),
q AS (SELECT CASE f WHEN 'A' THEN a * (1 - b) WHEN 'N' THEN (1 - a) * (1 - b) ELSE b END AS pt FROM p)
SELECT round(-avg(ln(least(greatest(pt, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM q"""

SQL["oof_coverage"] = f"""WITH {folds(53, 'any_value(8)', "(o_orderstatus = 'F')::INTEGER")} SELECT row_id, label, fold, 2::INTEGER AS classes FROM folded"""

SQL["prepared_parts"] = f"""WITH base AS (SELECT doc_id AS row_id, quality AS label FROM documents JOIN labels USING (doc_id)), {QUOTAS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h("'47:' || row_id")}, row_id) AS rn FROM base)
SELECT row_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part, 4::INTEGER AS width FROM ranked JOIN quotas USING (label)"""

SQL["ordered_split_text"] = """SELECT c_name AS row_id, CASE WHEN row_number() OVER (ORDER BY c_name) <= (SELECT floor(0.8 * count(*)) FROM customer) THEN 'train' ELSE 'test' END AS part FROM customer"""

SQL["ordered_split_large_ids"] = """SELECT 1152921504606846976 + o_orderkey AS row_id,
  CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT floor(0.3 * count(*)) FROM orders) THEN 'train' ELSE 'test' END AS part FROM orders"""

SQL["roc_auc_many_ranges"] = auc("SELECT (o_orderstatus = 'F')::INT AS label, o_totalprice AS score FROM orders")

SQL["encode_skewed_categories"] = """WITH o AS (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN 'always' ELSE 'c' || o_orderkey END AS a, 'k' || o_custkey AS b FROM orders)
SELECT row_id, (dense_rank() OVER (ORDER BY a) - 1)::INTEGER AS a, (dense_rank() OVER (ORDER BY b) - 1)::INTEGER AS b FROM o"""

# --- trees


def mixed(source: str, column: str, out: str) -> str:
    """A table with one more column: 64-bit values with their bits spread."""
    product = lambda c, k: f"CAST((CAST({c} AS UHUGEINT) * CAST({k} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"
    return f"""(SELECT * EXCLUDE (_b), xor(_b, _b >> 31) AS {out} FROM (SELECT * EXCLUDE (_a), {product('_a', 10723151780598845931)} AS _b FROM (
      SELECT * EXCLUDE (_b), xor(_b, _b >> 27) AS _a FROM (SELECT * EXCLUDE (_a), {product('_a', 13787848793156543929)} AS _b FROM (
        SELECT *, xor({column}, {column} >> 30) AS _a FROM {source})))))"""


def step(key: str, index: str) -> str:
    """The key plus ``index + 1`` steps, modulo 2^64."""
    return f"CAST((CAST({key} AS UHUGEINT) + (CAST({index} AS UHUGEINT) + 1) * CAST(11400714819323198485 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


SQL["tree_root_splits"] = f"""WITH {CELLS},
keys AS (SELECT tree, key FROM {mixed(f"(SELECT unnest(generate_series(0, 9))::INTEGER AS tree, {step('3', 'tree')} AS seeded)", 'seeded', 'key')}),
ranges AS (SELECT feature_idx, min(v) AS low, max(v) AS high FROM cells GROUP BY 1 HAVING max(v) > min(v)),
draws AS (SELECT tree, feature_idx, low, high, {step('key', 'feature_idx')} AS seeded FROM keys, ranges),
ordered AS (SELECT * FROM {mixed('draws', 'seeded', 'place')} QUALIFY row_number() OVER (PARTITION BY tree ORDER BY place) <= 8),
cuts AS (SELECT tree, feature_idx, place, low + (share >> 11) / 9007199254740992.0 * (high - low) AS threshold FROM {mixed('ordered', 'place', 'share')}),
sides AS (SELECT tree, feature_idx, place, threshold, label, count(*) FILTER (WHERE v <= threshold) AS l, count(*) FILTER (WHERE v > threshold) AS r FROM cuts JOIN cells USING (feature_idx) GROUP BY ALL),
gains AS (SELECT tree, feature_idx, place, threshold, sum(l)::BIGINT AS left_rows, sum(l * l) / sum(l)::DOUBLE + sum(r * r) / sum(r)::DOUBLE - sum((l + r) * (l + r)) / sum(l + r)::DOUBLE AS decrease, sum(l + r) AS n
  FROM sides GROUP BY ALL)
SELECT tree, feature_idx, round(threshold, 9) AS threshold, round(decrease, 6) AS decrease, left_rows FROM gains
QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round(decrease / n, 12) DESC, place) = 1"""

SQL["boosted_split"] = f"""WITH {CELLS},
cuts AS (SELECT feature_idx, q::DOUBLE AS cut FROM (
  SELECT feature_idx, max(v) AS top, unnest(list_distinct(quantile_cont(v, [{', '.join(str(i / 64) for i in range(1, 64))}]))) AS q FROM cells GROUP BY 1) WHERE q < top),
shares AS (SELECT c::INTEGER AS label, (count(label) + 1) / (SELECT count(*) + 10.0 FROM embeddings) AS p FROM (SELECT unnest(generate_series(0, 9)) AS c) LEFT JOIN embeddings ON label = c GROUP BY 1),
slopes AS (SELECT vec_id AS row_id, s.label, round_even((p - (e.label = s.label)::INTEGER) * 16777216, 0) AS g, round_even(p * (1 - p) * 16777216, 0) AS h FROM embeddings e, shares s),
sides AS (SELECT c.feature_idx, cut, s.label, sum(g) FILTER (WHERE v <= cut) / 16777216 AS gl, sum(h) FILTER (WHERE v <= cut) / 16777216 AS hl, sum(g) FILTER (WHERE v > cut) / 16777216 AS gr,
  sum(h) FILTER (WHERE v > cut) / 16777216 AS hr FROM cuts JOIN cells c USING (feature_idx) JOIN slopes s USING (row_id) GROUP BY ALL),
best AS (SELECT feature_idx, cut FROM sides GROUP BY ALL ORDER BY sum(gl * gl / (hl + 3) + gr * gr / (hr + 3) - (gl + gr) * (gl + gr) / (hl + hr + 3)) DESC, feature_idx, cut LIMIT 1)
SELECT label, feature_idx, round(cut, 6) AS threshold, round(-0.3 * gl / (hl + 3), 6) AS left_value, round(-0.3 * gr / (hr + 3), 6) AS right_value FROM sides JOIN best USING (feature_idx, cut)"""

SQL["boosted_rule"] = """WITH r AS (
  SELECT ((l_quantity > 25) <> (l_discount > 0.05))::INTEGER + (l_quantity > 25 AND l_tax > 0.04)::INTEGER AS label FROM lineitem WHERE l_orderkey % 4 = 0)
SELECT label, label AS prediction, count(*) AS n FROM r GROUP BY 1"""

SQL["target_statistics"] = f"""WITH o AS (
  SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS own, {h("'61:' || o_orderkey")} AS k,
    CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE o_custkey % 50 END AS customer, substr(o_orderpriority, 1, 1)::INTEGER AS priority FROM orders),
c AS (SELECT row_id, own, k, 0::INTEGER AS feature_idx, customer AS value FROM o UNION ALL SELECT row_id, own, k, 1::INTEGER, priority FROM o),
x AS (SELECT c.*, label::INTEGER AS label, (SELECT avg((own = label)::INTEGER) FROM o) AS prior FROM c, (SELECT unnest([0, 1, 2]) AS label))
SELECT row_id, feature_idx, label, round((coalesce(sum((own = label)::INTEGER) OVER w, 0) + prior) / (count(*) OVER w + 1), 6) AS mean
FROM x WINDOW w AS (PARTITION BY feature_idx, value, label ORDER BY k, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

# --- models on matrices

SQL["lasso_fold_coefficients"] = f"""WITH RECURSIVE {REG},
train AS (SELECT f.fold::INTEGER AS fold, r.* FROM reg r, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f WHERE r.row_id % 5 <> f.fold),
m AS (SELECT fold, feature_idx, avg(v) AS mv, stddev_pop(v) AS sv, avg(y) AS my FROM train GROUP BY 1, 2),
s AS MATERIALIZED (SELECT fold, row_id, feature_idx, (v - mv) / sv AS z, y - my AS y FROM train JOIN m USING (fold, feature_idx)),
g AS (SELECT a.fold, a.feature_idx AS i, b.feature_idx AS j, avg(a.z * b.z) AS g FROM s a JOIN s b USING (fold, row_id) GROUP BY ALL),
columns AS MATERIALIZED (SELECT fold, i, list(g ORDER BY j) AS g FROM g GROUP BY fold, i),
c AS (SELECT fold, feature_idx, avg(z * y) AS c FROM s GROUP BY ALL),
start AS MATERIALIZED (SELECT fold, list(c ORDER BY feature_idx) AS c, 0.1 * max(abs(c)) AS alpha FROM c GROUP BY fold),
descent AS (
  SELECT fold, 0 AS t, list_transform(c, lambda x: 0.0::DOUBLE) AS beta, c AS slopes, alpha FROM start
  UNION ALL
  SELECT fold, t + 1, list_transform(beta, lambda x, k: CASE WHEN k = pos THEN x + d ELSE x END), list_transform(slopes, lambda x, k: x - g[k] * d), alpha FROM (
    SELECT d.*, t % 63 + 1 AS pos, q.g, sign(r) * greatest(abs(r) - alpha, 0) / q.g[t % 63 + 1] - beta[t % 63 + 1] AS d
    FROM (SELECT *, 0 AS unused FROM descent WHERE t < 63 * 60) d JOIN columns q ON q.fold = d.fold AND q.i = d.t % 63, LATERAL (SELECT d.slopes[t % 63 + 1] + q.g[t % 63 + 1] * d.beta[t % 63 + 1] AS r)))
SELECT fold, (generate_subscripts(beta, 1) - 1)::INTEGER AS feature_idx, round(unnest(beta), 6) + 0.0 AS coefficient FROM descent WHERE t = 63 * 60"""

SQL["kernel_pivots"] = f"""WITH {CELLS},
first AS (SELECT vec_id AS z FROM embeddings ORDER BY {h("'0:' || vec_id")}, vec_id LIMIT 1),
k1 AS (SELECT a.row_id, exp(-sum((a.v - b.v) ** 2) / 64) AS c1 FROM cells a JOIN cells b USING (feature_idx) WHERE b.row_id = (SELECT z FROM first) GROUP BY 1),
second AS (SELECT row_id AS z, c1 AS z1 FROM k1 ORDER BY round(1 - c1 * c1, 12) DESC, {h("'0:' || row_id")}, row_id LIMIT 1),
k2 AS (SELECT k1.*, (k - c1 * z1) / sqrt(1 - z1 * z1) AS c2 FROM k1 JOIN (
  SELECT a.row_id, exp(-sum((a.v - b.v) ** 2) / 64) AS k FROM cells a JOIN cells b USING (feature_idx) WHERE b.row_id = (SELECT z FROM second) GROUP BY 1) USING (row_id), second),
third AS (SELECT row_id AS z, c1 AS z1, c2 AS z2 FROM k2 ORDER BY round(1 - c1 * c1 - c2 * c2, 12) DESC, {h("'0:' || row_id")}, row_id LIMIT 1),
k3 AS (SELECT k2.*, (k - c1 * z1 - c2 * z2) / sqrt(1 - z1 * z1 - z2 * z2) AS c3 FROM k2 JOIN (
  SELECT a.row_id, exp(-sum((a.v - b.v) ** 2) / 64) AS k FROM cells a JOIN cells b USING (feature_idx) WHERE b.row_id = (SELECT z FROM third) GROUP BY 1) USING (row_id), third),
t AS (SELECT sum(1 - c1 * c1 - c2 * c2 - c3 * c3) AS rest, count(*) * (var_pop(c1) + var_pop(c2) + var_pop(c3)) AS spanned FROM k3)
SELECT position::INTEGER AS position, z AS row_id, round((SELECT rest / (spanned + rest) FROM t), 8) AS residual
FROM (SELECT 0 AS position, z FROM first UNION ALL SELECT 1, z FROM second UNION ALL SELECT 2, z FROM third)"""

SQL["pca_very_wide"] = f"""WITH {CELLS},
j AS (SELECT unnest(generate_series(0, 5999)) AS j),
m AS (SELECT j, p, sum(w) AS w FROM (SELECT j, j % 64 AS p, 1.0::DOUBLE + (j % 7) / 10.0::DOUBLE AS w FROM j UNION ALL SELECT j, (j * 5 + 3) % 64, (j % 11) / 10.0::DOUBLE - 0.5::DOUBLE FROM j) GROUP BY 1, 2),
w AS (SELECT a.p AS p, b.p AS q, sum(a.w * b.w) AS w FROM m a JOIN m b USING (j) GROUP BY 1, 2),
s AS (SELECT a.feature_idx AS p, b.feature_idx AS q, covar_samp(a.v, b.v) AS s FROM cells a JOIN cells b USING (row_id) GROUP BY 1, 2),
x AS (SELECT s.p, w.q, sum(s * w) AS x FROM s JOIN w ON s.q = w.p GROUP BY 1, 2)
SELECT 64::INTEGER AS components, round((SELECT sum(x) FROM x WHERE p = q), 5) AS total, round((SELECT sum(a.x * b.x) FROM x a JOIN x b ON a.p = b.q AND a.q = b.p), 5) AS squares"""

# --- reports

RESULTS = """res AS (SELECT 'events' AS dataset_name, 'model_' || (user_id % 5) AS model, event_type AS method, (event_id % 10)::INTEGER AS repeat,
  (event_id % 3)::INTEGER AS fold, (100 * (1 + user_id % 14))::INTEGER AS num_features, value AS score, value * 0.9 AS val_score,
  value / 10 AS fold_time, event_id, ts, user_id, props FROM events)"""

SQL["method_summary"] = f"WITH {RESULTS} SELECT method, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std FROM res GROUP BY 1"

SQL["width_summary"] = f"""WITH {RESULTS} SELECT num_features, round(avg(score), 6) AS log_loss_mean, round(coalesce(stddev_samp(score), 0), 6) AS log_loss_std,
  count(*) AS n_rows FROM res GROUP BY 1 ORDER BY 1"""

SQL["width_summary_single_rows"] = "SELECT event_id::INTEGER AS num_features, value AS log_loss_mean, 0.0::DOUBLE AS log_loss_std, 1::BIGINT AS n_rows FROM events"

SQL["run_summary"] = f"""WITH {RESULTS} SELECT method, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std,
  round(avg(val_score), 6) AS val_mean, round(stddev_samp(val_score), 6) AS val_std FROM res GROUP BY 1"""

SQL["model_method_summary"] = f"""WITH {RESULTS} SELECT model, method, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(avg(val_score), 6) AS val_mean,
  round(stddev_samp(val_score), 6) AS val_std, CASE WHEN model = 'model_3' THEN model ELSE upper(model) END AS display_name FROM res GROUP BY model, method"""

SQL["comparison_matrix"] = f"""WITH {RESULTS} SELECT model, round(avg(score) FILTER (method = 'click'), 6) AS click, round(avg(score) FILTER (method = 'view'), 6) AS "view",
  round(avg(score) FILTER (method = 'error'), 6) AS error FROM res GROUP BY 1"""

SQL["fold_time_summary"] = f"WITH {RESULTS} SELECT method, round(avg(fold_time), 4) AS avg_fold_time, round(sum(fold_time), 4) AS total_elapsed_time FROM res GROUP BY 1"

SQL["results_union"] = """WITH a AS (SELECT 'events' AS dataset_name, event_type AS method, value AS score FROM events
  UNION ALL SELECT 'orders', o_orderstatus, o_totalprice FROM orders UNION ALL SELECT 'part', p_brand, p_retailprice FROM part)
SELECT dataset_name, method, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std FROM a GROUP BY 1, 2"""

SQL["coerce_dropna"] = f"WITH {RESULTS} SELECT event_id, round(score, 2) AS score FROM res WHERE user_id % 3 = 1"

SQL["valid_file_filter"] = f"WITH {RESULTS} SELECT 'run_' || user_id AS file, count(*) AS n_rows, count(*) AS n_valid FROM res WHERE user_id % 4 <> 0 GROUP BY 1"

SQL["results_config_join"] = f"""WITH {RESULTS}, d AS (SELECT DISTINCT user_id, num_features, 'set' || user_id || CASE WHEN user_id % 2 = 0 THEN '_num_features_' || num_features ELSE '' END AS stem FROM res)
SELECT stem || '_results.csv' AS file, stem, CASE WHEN user_id % 3 <> 0 AND user_id % 5 <> 0 THEN (user_id + 7)::INTEGER WHEN user_id % 2 = 0 THEN num_features END AS num_features FROM d"""

SQL["display_name"] = """SELECT c_custkey, c_nationkey::VARCHAR AS model, coalesce((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey AND n_nationkey::VARCHAR < '5'), c_nationkey::VARCHAR) AS display_name FROM customer"""

SQL["slug"] = "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || replace(lower(p_brand), '#', '_') AS slug FROM part"

SQL["name_regex"] = f"WITH {RESULTS} SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN num_features END AS num_features FROM res"

SQL["hyperparam_regex"] = f"""WITH {RESULTS} SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN user_id::INTEGER END AS seed, CASE WHEN user_id % 4 <> 0 THEN num_features END AS nf,
  CASE WHEN user_id % 4 <> 0 THEN ('0.' || printf('%02d', event_id % 100))::DOUBLE END AS vt, CASE WHEN user_id % 4 <> 0 THEN repeat END AS nte FROM res"""

SQL["kv_parse"] = """SELECT o_orderkey, 'seed' AS key, o_custkey::VARCHAR AS string_value, 'int' AS kind, 0::INTEGER AS indent, o_custkey AS int_value, NULL::DOUBLE AS float_value, NULL::BOOLEAN AS bool_value FROM orders
UNION ALL SELECT o_orderkey, 'price', printf('%.2f', o_totalprice), 'float', 2, NULL, round(o_totalprice, 2), NULL FROM orders
UNION ALL SELECT o_orderkey, 'done', CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END, 'bool', 0, NULL, NULL, o_orderstatus = 'F' FROM orders
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 'string', 0, NULL, NULL, NULL FROM orders"""

SQL["deep_key_search"] = "SELECT event_id, CASE WHEN user_id % 3 < 2 THEN json_extract(props, '$.k')::INTEGER END AS k FROM events"

SQL["run_id"] = f"WITH {RESULTS} SELECT event_id, dataset_name || '_' || method || '_num_features_' || num_features || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM res"

METHODS = """m AS (SELECT * FROM (VALUES (0, 'original', 'None'), (1, 'random_fs', 'Random selection'), (2, 'variance_fs', 'Variance threshold'),
  (3, 'tree_fs', 'Tree-based estimators'), (4, 'kbest_fs', 'K best selection'), (5, 'pca_dr', 'PCA'), (6, 'random_dr', 'Gaussian random projection'),
  (7, 'agglo_dr', 'Feature agglomeration'), (8, 'kpca_dr', 'Kernel PCA'), (9, 'kbest+pca', 'K best selection + PCA'), (10, 'sand_fs', 'SAND layer'),
  (11, 'lasso_fs', 'Lasso'), (12, 'tabpfn_fs', 'TabPFN-wide+decoder')) t(i, method, full_name))"""

SQL["method_category"] = f"""WITH {METHODS} SELECT event_id, method, CASE method WHEN 'original' THEN 'Original' WHEN 'kbest+pca' THEN 'Feature selection + Dimensionality reduction'
  ELSE CASE WHEN method LIKE '%\\_fs' ESCAPE '\\' THEN 'Feature selection' ELSE 'Dimensionality reduction' END END AS category, full_name
FROM events JOIN m ON user_id % 13 = i"""

SQL["metric_choice"] = """WITH t AS (SELECT event_id, value, CASE user_id % 4 WHEN 0 THEN 'rmse' WHEN 1 THEN 'roc_auc' WHEN 2 THEN 'log_loss' END AS metric FROM events)
SELECT event_id, metric, CASE metric WHEN 'rmse' THEN 'root_mean_squared_error' ELSE metric END AS learner_metric,
  CASE WHEN metric IN ('rmse', 'log_loss') THEN -value ELSE value END AS score FROM t"""

SQL["budget_split"] = "SELECT event_id, round_even(user_id * 0.75, 0)::INTEGER AS k1, (user_id - round_even(user_id * 0.75, 0))::INTEGER AS k2 FROM events"

SQL["experiment_grid"] = """WITH d AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'csv:/data/' || p_size ELSE 'hiva' END AS dataset FROM part)
SELECT dataset, CASE WHEN dataset LIKE 'csv:%' THEN 'csv_path:' || substr(dataset, 5) WHEN dataset = 'hiva' THEN 'task:363677' ELSE 'task:' || dataset END AS source, model, method
FROM d, (SELECT unnest(['gbt', 'linear']) AS model), (SELECT unnest(['original', 'kbest_fs', 'pca_dr']) AS method)"""
