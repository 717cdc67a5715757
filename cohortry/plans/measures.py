"""Queries over entities, replicates, errors, reports and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import clean as C
from cohortry.operators import entity as E
from cohortry.operators import evaluate as V
from cohortry.operators import features as X
from cohortry.operators import reports as R
from cohortry.operators import trees
from cohortry.operators.splits import cv_roles, kfold_stratified, order_key
from cohortry.plans.base import query, rounded, table
from cohortry.plans.cleaning import gradients
from cohortry.sources.tables import fold_keys as fold_keys_of

THRESHOLD = 0.025


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS g", "l_partkey AS e", "l_extendedprice AS y", "l_quantity AS q")


GROUPS_SQL = """
SELECT 'cc_' || row_number() OVER (ORDER BY (n = 1)::INTEGER, first) AS group_id, members, n::INTEGER AS n, first
FROM (SELECT count(*) AS n, list_sort(list(p_partkey)) AS members, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type, p_size)
"""


@query(f"SELECT group_id, array_to_string(members, ',') AS members, n FROM ({GROUPS_SQL})")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    groups = E.entity_merge(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])
    return groups.select("group_id", F.array_join("members", ",").alias("members"), "n")


@query(f"""
WITH g AS ({GROUPS_SQL}), m AS (SELECT group_id, unnest(members) AS p_partkey FROM g)
SELECT group_id, p_partkey, p_retailprice FROM (SELECT m.group_id, p.*, row_number() OVER (PARTITION BY m.group_id ORDER BY p.p_partkey) AS k FROM m JOIN part p USING (p_partkey)) WHERE k = 1
""")
def remap_key(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    conditions = ["p_brand", "p_type", "p_size"]
    members = E.group_members(part, "p_partkey", conditions, E.merge_conditions(part, "p_partkey", conditions))
    return E.remap_key(part, members, "p_partkey").select("group_id", "p_partkey", "p_retailprice")


COUNTED = "SELECT l_suppkey AS g, l_partkey AS e, l_extendedprice AS y, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n FROM lineitem"


@query(f"SELECT g, e, y FROM ({COUNTED}) WHERE n > 1")
def replicates(spark: SparkSession, d: str) -> DataFrame:
    return E.replicates(lines(spark, d), "g", "e")[1].select("g", "e", "y")


@query(f"SELECT g, e, y FROM ({COUNTED}) WHERE n = 1")
def non_replicates(spark: SparkSession, d: str) -> DataFrame:
    return E.replicates(lines(spark, d), "g", "e")[0].select("g", "e", "y")


SETS = f"""
SELECT s.*, limit_, NOT (high - low > limit_) AS kept
FROM (SELECT l_suppkey AS g, l_partkey AS e, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1, 2) s
JOIN (SELECT l_suppkey AS g, max(l_extendedprice) * {THRESHOLD} AS limit_ FROM lineitem GROUP BY 1) t USING (g)
"""


@query(f"SELECT g, e, round(mean, 6) AS y, n FROM ({SETS}) WHERE n = 1 OR kept")
def reconcile_kept(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.reconcile(lines(spark, d), "g", "e", "y"), "y")


@query(f"SELECT g, e, n, low, high FROM ({SETS}) WHERE n > 1 AND NOT kept")
def reconcile_dropped(spark: SparkSession, d: str) -> DataFrame:
    return E.replicate_sets(lines(spark, d), "g", "e", "y").filter("n > 1 AND NOT kept").select("g", "e", "n", "low", "high")


@query(f"""
SELECT sum(n)::BIGINT AS total_rows, (sum(n) FILTER (WHERE n > 1))::BIGINT AS replicate_rows, count(*) FILTER (WHERE n > 1 AND kept) AS sets_kept,
  count(*) FILTER (WHERE n > 1 AND NOT kept) AS sets_dropped, (sum(n) FILTER (WHERE n > 1 AND NOT kept))::BIGINT AS rows_dropped, count(*) FILTER (WHERE n = 1 OR kept) AS rows_remaining FROM ({SETS})
""")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.reconcile_summary(lines(spark, d), "g", "e", "y")


@query("SELECT event_id, user_id, value, max(value) OVER w AS max_value, round(avg(value) OVER w, 6) AS mean_value FROM events WINDOW w AS (PARTITION BY user_id)")
def group_max_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = E.group_max_mean(table(spark, d, "events"), "user_id", "value")
    return rounded(rows.select("event_id", "user_id", "value", "max_value", "mean_value"), "mean_value")


@query("SELECT c_nationkey AS k, count(*) FILTER (WHERE c_acctbal >= 0) AS retained, count(*) FILTER (WHERE c_acctbal < 0) AS rejected FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_acctbal < 0) > 0")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.expr("CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE 'retained' END").alias("status"))
    return R.status_counts(rows, "k", "status", "rejected")


@query("SELECT coalesce(p_brand, 'Total') AS group_key, count(*) AS n, grouping(p_brand)::INTEGER AS is_total FROM part GROUP BY ROLLUP (p_brand)")
def group_count_total(spark: SparkSession, d: str) -> DataFrame:
    return R.group_count_total(table(spark, d, "part"), "p_brand")


@query("""
SELECT CASE WHEN grouping(k) = 1 THEN 'Total' ELSE k::VARCHAR END AS source, sum(customers)::BIGINT AS customers, sum(suppliers)::BIGINT AS suppliers
FROM (SELECT n_nationkey AS k, customers, suppliers FROM nation JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON n_nationkey = c_nationkey
  JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey) GROUP BY ROLLUP (k)
""")
def summary_with_total(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    tables = {"customers": table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "suppliers": table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))}
    return R.summary_with_total(keys, tables, "k")


@query("""
WITH a AS (SELECT count(*) AS n FROM lineitem), b AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity > 5),
c AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 5 GROUP BY 1 HAVING count(*) >= 540))
SELECT 1 AS position, 'low quantity' AS stage, a.n - b.n AS dropped FROM a, b UNION ALL SELECT 2, 'small groups', b.n - c.n FROM b, c UNION ALL SELECT 3, 'total', a.n - c.n FROM a, c
""")
def drop_waterfall(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    some = rows.filter("q > 5")
    return R.waterfall([("input", rows), ("low quantity", some), ("small groups", C.min_group_size(some, "g", 540))])


@query("""
WITH a AS (SELECT count(*) AS n FROM lineitem), b AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity > 5),
c AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 5 GROUP BY 1 HAVING count(*) >= 540))
SELECT 1 AS position, 'low quantity' AS stage, a.n - b.n AS dropped FROM a, b UNION ALL SELECT 2, 'small groups', b.n - c.n FROM b, c UNION ALL SELECT 3, 'total', a.n - c.n FROM a, c
""")
def flow_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, taken while the rows flow."""
    return R.flow(lines(spark, d), [("low quantity", lambda x: x.filter("q > 5")), ("small groups", lambda x: C.min_group_size(x, "g", 540))])[1]


@query("SELECT l_suppkey::VARCHAR AS dropped FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey HAVING count(*) < 540 UNION SELECT l_suppkey::VARCHAR FROM lineitem GROUP BY l_suppkey HAVING max(l_quantity) <= 5")
def dropped_names(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    return R.dropped_keys(rows, C.min_group_size(rows.filter("q > 5"), "g", 540), "g")


GRADIENTS = """
g AS (SELECT c_nationkey AS k, count(*) AS n, count(CASE WHEN c_nationkey % 7 = 3 AND c_custkey % 2 = 0 THEN NULL ELSE c_custkey END) AS t FROM customer GROUP BY 1),
lost AS (SELECT k, n FROM g WHERE k % 11 = 4 OR t < n)
"""


@query(f"WITH {GRADIENTS} SELECT k::VARCHAR AS source, n FROM lost UNION ALL SELECT 'Total', coalesce(sum(n), 0)::BIGINT FROM lost")
def unusable_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources without a usable gradient and their rows in total."""
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("nation")).agg(F.count("*").alias("n"))
    return R.unusable_sources(counts, gradients(spark, d), "nation", "n", [C.GRADIENT_EMPTY, C.GRADIENT_LOST])


@query("""
WITH s AS (SELECT n_regionkey AS method, c_nationkey::VARCHAR AS source, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT method, source, n FROM s UNION ALL SELECT method, 'Total', sum(n)::BIGINT FROM s GROUP BY method
""")
def totals_by_method(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("method")), "c_nationkey")
    return R.totals_by_method(rows.groupBy("method", "c_nationkey").agg(F.count("*").alias("n")), "method", "c_nationkey", "n")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = rows.selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS g", "p_brand AS c", "l_extendedprice AS y", "l_quantity * 1000 AS p")
    rows = E.group_max_mean(rows, "g", "y")
    return V.row_errors(rows, "y", "p", "max_value", "mean_value")


PREDICTED = """
SELECT *, abs(p - y) AS diff, abs(p - y) * 100 / top AS rel_error_max, abs(p - y) * 100 / mean AS rel_error_mean, abs(p - y) * 100 / y AS mre
FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS g, p_brand AS c, l_extendedprice AS y, l_quantity * 1000 AS p, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS top,
  avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
METRICS = """count(*) AS n, round(avg(diff), 6) AS mae, round(sqrt(avg(diff * diff)), 6) AS rmse, round(avg(mre), 6) AS mre,
  round(avg(rel_error_max), 6) AS rel_error_max, round(avg(rel_error_mean), 6) AS rel_error_mean"""


@query(f"SELECT l_orderkey, l_linenumber, g, diff, round(rel_error_max, 6) AS rel_error_max, round(rel_error_mean, 6) AS rel_error_mean, round(mre, 6) AS mre FROM ({PREDICTED})")
def row_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).select("l_orderkey", "l_linenumber", "g", "diff", "rel_error_max", "rel_error_mean", "mre")
    return rounded(rows, "rel_error_max", "rel_error_mean", "mre")


@query(f"SELECT {METRICS} FROM ({PREDICTED})")
def metrics_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.metrics(predictions(spark, d)), *V.METRICS)


@query(f"SELECT g, {METRICS} FROM ({PREDICTED}) GROUP BY g")
def metrics_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.metrics(predictions(spark, d), "g"), *V.METRICS)


@query(f"SELECT g, c, CASE WHEN grouping(g) = 0 THEN 'g' WHEN grouping(c) = 0 THEN 'c' ELSE 'all' END AS level, {METRICS} FROM ({PREDICTED}) GROUP BY GROUPING SETS ((g), (c), ())")
def metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.metrics_by_each(predictions(spark, d), "g", "c"), *V.METRICS)


@query(f"SELECT round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 9) AS r2 FROM ({PREDICTED}), (SELECT avg(y) AS m FROM ({PREDICTED}))")
def r2_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.r2_score(predictions(spark, d).select("y", "p"), "y", "p"), "r2", digits=9)


K = 10


def event_folds(spark: SparkSession, d: str) -> DataFrame:
    """Events as predictions with folds: the value against its user's mean-free guess."""
    rows = kfold_stratified(table(spark, d, "events"), "user_id", "event_id", K)
    rows = rows.selectExpr("event_id", "user_id AS g", "event_type AS c", "fold", "value AS y", "CAST(event_id % 100 AS DOUBLE) AS p")
    return V.row_errors(E.group_max_mean(rows, "g", "y"), "y", "p", "max_value", "mean_value")


FOLDED = f"""
SELECT *, abs(p - y) AS diff, abs(p - y) * 100 / top AS rel_error_max, abs(p - y) * 100 / mean AS rel_error_mean, CASE WHEN y <> 0 THEN abs(p - y) * 100 / y END AS mre
FROM (SELECT event_id, user_id AS g, event_type AS c, value AS y, (event_id % 100)::DOUBLE AS p, max(value) OVER (PARTITION BY user_id) AS top, avg(value) OVER (PARTITION BY user_id) AS mean,
  (ntile({K}) OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR || '42'), event_id) - 1)::INTEGER AS fold FROM events)
"""
RAW = "count(*) AS n, avg(diff) AS mae, sqrt(avg(diff * diff)) AS rmse, avg(mre) AS mre, avg(rel_error_max) AS rel_error_max, avg(rel_error_mean) AS rel_error_mean"
LONG = "UNPIVOT ({src}) ON mae, rmse, mre, rel_error_max, rel_error_mean INTO NAME metric VALUE x"


def weighted_sql(src: str, keys: str = "") -> str:
    by, using = f"{keys} metric" if not keys else f"{keys}, metric", f"({keys + ', ' if keys else ''}metric)"
    by = by.strip()
    return f"""
WITH l AS ({LONG.format(src=src)}), m AS (SELECT {by}, sum(n * x) / sum(n) AS mean FROM l GROUP BY ALL)
SELECT {by}, round(mean, 6) AS mean, round(sqrt(sum(n * (x - mean) * (x - mean)) / sum(n)), 6) AS std FROM l JOIN m USING {using} GROUP BY {by}, mean
"""


@query(weighted_sql(f"SELECT fold, {RAW} FROM ({FOLDED}) GROUP BY fold"))
def weighted_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.weighted(V.metrics(event_folds(spark, d), "fold"), V.METRICS, "n"), "mean", "std")


@query(f"""
SELECT fold, ((fold + 1) % {K})::INTEGER AS val_fold, n, metric, round(x, 6) AS value FROM ({LONG.format(src=f"SELECT fold, {RAW} FROM ({FOLDED}) GROUP BY fold")})
""")
def fold_summary_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.fold_summary(event_folds(spark, d), "fold", K), "value")


@query(weighted_sql(f"SELECT g, fold, {RAW} FROM ({FOLDED}) GROUP BY g, fold", "g"))
def weighted_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.weighted(V.metrics(event_folds(spark, d), "g", "fold"), V.METRICS, "n", ["g"]), "mean", "std")


@query(weighted_sql(f"SELECT g, fold, {RAW} FROM ({FOLDED}) GROUP BY g, fold"))
def weighted_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.weighted(V.metrics(event_folds(spark, d), "g", "fold"), V.METRICS, "n"), "mean", "std")


TWO = ", ".join(f"sum(n * {m}) / sum(n) AS {m}" for m in V.METRICS)


@query(weighted_sql(f"SELECT fold, {TWO}, sum(n)::BIGINT AS n FROM (SELECT g, fold, {RAW} FROM ({FOLDED}) GROUP BY g, fold) GROUP BY fold"))
def weighted_two_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.two_level(V.metrics(event_folds(spark, d), "g", "fold"), V.METRICS, "n", "fold"), "mean", "std")


@query(f"SELECT fold, {METRICS} FROM ({FOLDED}) WHERE event_id IN (SELECT event_id FROM events WHERE event_type <> 'click') GROUP BY fold")
def metrics_excluding(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "events").filter("event_type <> 'click'").select("event_id")
    return rounded(V.metrics_excluding(event_folds(spark, d), keep, "event_id", "fold"), *V.METRICS)


@query(f"SELECT fold, g, count(*) AS n FROM ({FOLDED}) GROUP BY fold, g")
def fold_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of each fold and their rows."""
    return fold_keys_of(event_folds(spark, d), "g")


@query(f"""
WITH w AS ({weighted_sql(f"SELECT g, fold, {RAW} FROM ({FOLDED}) GROUP BY g, fold", "g")})
SELECT g, {", ".join(f"max(CASE WHEN metric = '{m}' THEN {x} END) AS {m}_{x}" for m in ("mae", "rmse") for x in ("mean", "std"))} FROM w GROUP BY g
""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A row a run with mean and deviation of each metric; each user is a run."""
    found = rounded(V.weighted(V.metrics(event_folds(spark, d), "g", "fold"), V.METRICS, "n", ["g"]), "mean", "std")
    return R.run_comparison(found, "g")


@query(f"SELECT fold, count(*) AS n FROM ({FOLDED}) GROUP BY fold")
def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return event_folds(spark, d).groupBy("fold").agg(F.count("*").alias("n"))


@query(f"""
WITH f AS ({FOLDED}), t AS (
  SELECT a.g, a.fold, (SELECT count(*) FROM f z WHERE z.g = a.g AND z.fold = a.fold) AS n_test, count(*) AS n, sum(b.p) AS sx, sum(b.y) AS sy, sum(b.p * b.p) AS sxx, sum(b.p * b.y) AS sxy
  FROM (SELECT DISTINCT g, fold FROM f) a JOIN f b ON a.g = b.g AND b.fold <> a.fold AND b.fold <> (a.fold + 1) % {K} GROUP BY a.g, a.fold)
SELECT g, fold, n_test, n AS n_train, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) AS slope,
  round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 6) AS intercept FROM t
""")
def group_cv_regression(spark: SparkSession, d: str) -> DataFrame:
    fits = V.regression_by_group_fold(event_folds(spark, d), "g", "fold", "p", "y", K)
    return rounded(fits, "slope", "intercept")


@query(f"""
WITH f AS (SELECT *, (event_id % 7)::DOUBLE AS b FROM ({FOLDED})),
m AS (SELECT a.g, a.fold, (SELECT count(*) FROM f z WHERE z.g = a.g AND z.fold = a.fold) AS n_test, count(*) AS n, avg(x.p) AS ma, avg(x.b) AS mb, avg(x.y) AS my, var_pop(x.p) AS saa, var_pop(x.b) AS sbb,
  covar_pop(x.p, x.b) AS sab, covar_pop(x.p, x.y) AS say, covar_pop(x.b, x.y) AS sby
  FROM (SELECT DISTINCT g, fold FROM f) a JOIN f x ON a.g = x.g AND x.fold <> a.fold AND x.fold <> (a.fold + 1) % {K} GROUP BY a.g, a.fold),
w AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM m)
SELECT g, fold, n_test, n AS n_train, round(my - wa * ma - wb * mb, 6) AS intercept, round(wa, 6) AS w_p, round(wb, 6) AS w_b FROM w
""")
def group_cv_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Models of two features for each user and fold."""
    rows = event_folds(spark, d).withColumn("b", F.col("event_id") % 7)
    fits = V.regressions_by_group_fold(rows, "g", "fold", ["p", "b"], "y", K)
    return rounded(fits.select("g", "fold", "n_test", "n_train", "intercept", F.col("weights")[0].alias("w_p"), F.col("weights")[1].alias("w_b")), "intercept", "w_p", "w_b")


SCALED = ["p_size", "p_retailprice"]


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round((p.p_size - m1) / s1, 6) AS p_size, round((p.p_retailprice - m2) / s2, 6) AS p_retailprice FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey,
(SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 10 < 8))
""")
def scale_by_group_fit(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    scaler = X.fit_scaler(rows.filter("l_orderkey % 10 < 8"), SCALED, "l_partkey")
    return rounded(X.apply_scaler(rows, scaler, SCALED), *SCALED)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_tax - m2) / s2, 6) AS l_tax FROM lineitem,
(SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem WHERE l_orderkey % 10 < 8)
""")
def scale_train_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    scaler = X.fit_scaler(rows.filter("l_orderkey % 10 < 8"), ["l_quantity", "l_tax"])
    return rounded(X.apply_scaler(rows, scaler, ["l_quantity", "l_tax"]), "l_quantity", "l_tax")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity || ',' || l_discount || ',' || l_tax AS features FROM lineitem")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = X.feature_vector(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


def order_folds(spark: SparkSession, d: str) -> DataFrame:
    """Orders with folds and two features."""
    rows = kfold_stratified(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey"), "o_orderpriority", "o_orderkey", K)
    return rows.withColumns({"a": F.col("o_orderkey") % 97, "b": F.col("o_custkey") % 31})


@query(f"""
WITH f AS (SELECT o_orderkey, o_orderpriority AS pr, o_totalprice AS y, o_orderkey % 97 AS a, o_custkey % 31 AS b, ntile({K}) OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) - 1 AS fold FROM orders),
r AS (SELECT unnest(generate_series(0, {K - 1}))::INTEGER AS run),
m AS (SELECT run, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM r JOIN f ON fold <> run AND fold <> (run + 1) % {K} GROUP BY 1),
w AS (SELECT run, ma, mb, my, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM m),
p AS (SELECT run, y, my + wa * (a - ma) + wb * (b - mb) AS p, max(y) OVER (PARTITION BY pr) AS top, avg(y) OVER (PARTITION BY pr) AS mean FROM f JOIN w ON fold = run),
e AS (SELECT run, abs(p - y) AS diff, abs(p - y) * 100 / top AS rel_error_max, abs(p - y) * 100 / mean AS rel_error_mean, abs(p - y) * 100 / y AS mre FROM p)
SELECT run, {METRICS.replace(", 6)", ", 3)")} FROM e GROUP BY run
""")
def cv_models(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of one model per fold, and their metrics."""
    rows = order_folds(spark, d)
    out = V.pooled_models(rows, cv_roles(K, spark), ["a", "b"], "o_totalprice", "fold")
    out = V.row_errors(E.group_max_mean(out, "o_orderpriority", "o_totalprice"), "o_totalprice", "predicted", "max_value", "mean_value")
    return rounded(V.metrics(out, "run"), *V.METRICS, digits=3)


#: Trees of the queries: widths of the features' bins, levels, least rows of a side.
WIDTHS, LEVELS, SIDE = {"a": 8, "b": 4}, 3, 20


def trees_sql() -> str:
    """CTEs: ``n0``.. rows of every run at their nodes, ``s0``.. the splits of each level."""
    out = [
        f"""
f AS (SELECT o_orderkey, o_orderpriority AS pr, o_totalprice AS y, (o_orderkey % 97) // {WIDTHS["a"]} AS a, (o_custkey % 31) // {WIDTHS["b"]} AS b, ntile({K}) OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) - 1 AS fold FROM orders),
r AS (SELECT unnest(generate_series(0, {K - 1}))::INTEGER AS run),
n0 AS MATERIALIZED (SELECT run, f.*, fold = run AS test, y - (SELECT avg(y) FROM f) AS d, 0 AS node FROM r JOIN f ON fold <> (run + 1) % {K})"""
    ]
    for i in range(LEVELS):
        out.append(f"""
h{i} AS (SELECT run, node, j, bin, count(*) AS k, sum(d) AS s FROM (SELECT run, node, d, unnest([0, 1]) AS j, unnest([a, b]) AS bin FROM n{i} WHERE NOT test AND node >= {2**i - 1}) GROUP BY ALL),
c{i} AS (SELECT run, node, j, bin + 1 AS cut, sum(k) OVER u AS kl, sum(s) OVER u AS sl, sum(k) OVER t AS n, sum(s) OVER t AS s FROM h{i} WINDOW t AS (PARTITION BY run, node, j), u AS (PARTITION BY run, node, j ORDER BY bin)),
s{i} AS MATERIALIZED (SELECT run, node, j, cut, gain, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY run, node ORDER BY gain DESC, j, cut) AS place FROM
  (SELECT *, sl * sl / kl + (s - sl) * (s - sl) / (n - kl) - s * s / n AS gain FROM c{i} WHERE kl >= {SIDE} AND n - kl >= {SIDE})) WHERE place = 1),
n{i + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN z.j IS NULL THEN x.node ELSE 2 * x.node + 1 + (CASE WHEN z.j = 0 THEN a ELSE b END >= z.cut)::INTEGER END AS node) FROM n{i} x LEFT JOIN s{i} z ON x.run = z.run AND x.node = z.node)""")
    return ",".join(out)


def order_trees(spark: SparkSession, rows: DataFrame) -> trees.Trees:
    cuts = {"a": list(range(8, 97, WIDTHS["a"])), "b": list(range(4, 31, WIDTHS["b"]))}
    return trees.grow(rows, cv_roles(K, spark), ["a", "b"], "o_totalprice", "fold", LEVELS, least=SIDE, cuts=cuts)


@query(f"""
WITH {trees_sql()}
SELECT run, node, CASE j WHEN 0 THEN 'a' ELSE 'b' END AS feature, (cut * CASE j WHEN 0 THEN {WIDTHS["a"]} ELSE {WIDTHS["b"]} END)::DOUBLE AS threshold, round(gain / 1e6, 3) AS gain, n
FROM ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(LEVELS))})
""")
def cv_tree_splits(spark: SparkSession, d: str) -> DataFrame:
    """The splits of one regression tree per fold, gains in millions."""
    return rounded(order_trees(spark, order_folds(spark, d)).splits().withColumn("gain", F.col("gain") / 1e6), "gain", digits=3)


@query(f"""
WITH {trees_sql()}, leaf AS (SELECT run, node, avg(y) AS p FROM n{LEVELS} WHERE NOT test GROUP BY 1, 2),
p AS (SELECT run, y, p, top, mean FROM n{LEVELS} JOIN leaf USING (run, node) JOIN (SELECT pr, max(y) AS top, avg(y) AS mean FROM f GROUP BY 1) USING (pr) WHERE test),
e AS (SELECT run, abs(p - y) AS diff, abs(p - y) * 100 / top AS rel_error_max, abs(p - y) * 100 / mean AS rel_error_mean, abs(p - y) * 100 / y AS mre FROM p)
SELECT run, {METRICS.replace(", 6)", ", 3)")} FROM e GROUP BY run
""")
def cv_trees(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of one regression tree per fold, and their metrics."""
    rows = order_folds(spark, d)
    out = order_trees(spark, rows).predict(rows, cv_roles(K, spark), "fold")
    out = V.row_errors(E.group_max_mean(out, "o_orderpriority", "o_totalprice"), "o_totalprice", "predicted", "max_value", "mean_value")
    return rounded(V.metrics(out, "run"), *V.METRICS, digits=3)


#: Of the trials: small enough that the lasso keeps the signs of least squares, which the SQL relies on.
PENALTIES, MIXES = [0.0, 0.1, 3.0], [0.0, 0.5, 1.0]


@query(f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS y, (o_orderkey % 97)::DOUBLE AS a, (o_custkey % 31)::DOUBLE AS b FROM orders),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS da, stddev_pop(b) AS db, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb FROM o WHERE o_orderkey % 10 < 8),
t AS (SELECT unnest({PENALTIES})::DOUBLE AS penalty), x AS (SELECT unnest({MIXES})::DOUBLE AS mix),
s AS (SELECT *, 1 + penalty * (1 - mix) AS d, ca - penalty * mix * sign(ca - r * cb) AS ta, cb - penalty * mix * sign(cb - r * ca) AS tb FROM m, t, x),
w AS (SELECT *, (d * ta - r * tb) / (d * d - r * r) / da AS wa, (d * tb - r * ta) / (d * d - r * r) / db AS wb FROM s)
SELECT penalty, mix, round(avg((y - my - wa * (a - ma) - wb * (b - mb)) ** 2) / 1e6, 6) AS val_loss FROM w, o WHERE o_orderkey % 10 = 8 GROUP BY penalty, mix
""")
def hyper_search(spark: SparkSession, d: str) -> DataFrame:
    """Trials of penalised models by loss, in millions."""
    rows = table(spark, d, "orders").withColumns({"a": (F.col("o_orderkey") % 97).cast("double"), "b": (F.col("o_custkey") % 31).cast("double")})
    found = X.grid_search(rows.filter("o_orderkey % 10 < 8"), rows.filter("o_orderkey % 10 = 8"), ["a", "b"], "o_totalprice", PENALTIES, MIXES)
    return rounded(found.withColumn("val_loss", F.col("val_loss") / 1e6), "val_loss")


@query(f"""
WITH kept AS (SELECT g, e, mean AS y FROM ({SETS}) WHERE n = 1 OR kept), big AS (SELECT g FROM kept GROUP BY g HAVING count(*) >= 20),
r AS (SELECT kept.g, kept.y, p_size * 1000.0 AS p FROM kept JOIN part ON e = p_partkey WHERE g IN (SELECT g FROM big))
SELECT g, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM r GROUP BY g
""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Replicates reconciled, small groups dropped, joined with conditions, errors by group."""
    kept = C.min_group_size(E.reconcile(lines(spark, d), "g", "e", "y", THRESHOLD), "g", 20)
    rows = kept.join(table(spark, d, "part").select(F.col("p_partkey").alias("e"), (F.col("p_size") * 1000.0).alias("p")), "e")
    diff = F.col("p") - F.col("y")
    out = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"))
    return rounded(out, "mae", "rmse")
