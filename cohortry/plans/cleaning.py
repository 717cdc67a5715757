"""Queries over scalar functions, filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.operators import clean as C
from cohortry.plans.base import SEGMENT_ORDER, SEGMENT_SQL, query, table
from cohortry.sources import tables as T

NULLED = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END"


def part_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("price", F.expr(NULLED))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def numeric_or_fail(spark: SparkSession, d: str) -> DataFrame:
    """Prices as text to numbers; a text that is none would fail the query."""
    text = part_with_nulls(spark, d).withColumn("text", F.col("price").cast("string"))
    return text.select("p_partkey", S.numeric_or_fail(F.col("text"), "price").alias("price"))


@query("""
SELECT e.k AS nation, coalesce(f.n, 0) AS n, CASE WHEN f.n IS NULL THEN 'not found' WHEN f.d = 0 THEN 'only canonical' ELSE 'found' END AS status
FROM (SELECT unnest(generate_series(0, 29))::INTEGER AS k) e
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, count(CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_name END) AS d FROM customer GROUP BY 1) f ON e.k = f.k
""")
def source_status(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(30).select(F.col("id").cast("int").alias("nation"))
    found = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.expr("CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_name END").alias("detail"))
    return C.source_status(expected, found, "nation", "detail")


@query("""
WITH e AS (SELECT unnest(generate_series(0, 29)) AS nation), r AS (SELECT c_nationkey AS nation, CASE WHEN c_nationkey % 7 = 3 AND c_custkey % 2 = 0 THEN NULL ELSE c_custkey END AS t,
  CASE WHEN c_nationkey % 5 = 1 AND c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS flow FROM customer WHERE c_nationkey % 11 <> 4),
g AS (SELECT nation, count(*) AS n, count(*) - count(t) AS no_t, count(*) - count(flow) AS no_f FROM r GROUP BY 1)
SELECT e.nation::INTEGER AS nation, CASE WHEN e.nation > 24 THEN 'Gradient.tsv not found' WHEN n IS NULL OR no_t > 0 THEN 'Empty data table' WHEN no_f > 0 THEN 'Need flow rate imputation' ELSE 'Gradient data ok' END AS status,
  CASE WHEN n IS NULL OR no_t > 0 THEN 0 ELSE n END::BIGINT AS n FROM e LEFT JOIN g ON e.nation = g.nation
""")
def gradient_status(spark: SparkSession, d: str) -> DataFrame:
    return gradients(spark, d)


def gradients(spark: SparkSession, d: str) -> DataFrame:
    """Customers as the segments of their nation's gradient; some lack times or flow rates, some nations have none."""
    expected = spark.range(30).select(F.col("id").cast("int").alias("nation"))
    rows = table(spark, d, "customer").filter("c_nationkey % 11 <> 4").selectExpr(
        "c_nationkey AS nation", "CASE WHEN c_nationkey % 7 = 3 AND c_custkey % 2 = 0 THEN NULL ELSE c_custkey END AS t", "CASE WHEN c_nationkey % 5 = 1 AND c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS flow"
    )
    return C.gradient_status(expected, rows, "nation", "t", "flow", table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("nation")))


@query("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) >= 4 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 4, '0') END AS padded FROM part")
def pad_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.pad_key(F.col("p_partkey")).alias("padded"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS prefix FROM orders")
def split_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.id_prefix(F.col("o_orderpriority"), "-").alias("prefix"))


@query("SELECT event_id, round_even(value * 60 * 100, 0) / 100 AS seconds FROM events")
def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.minutes_to_seconds(F.col("value")).alias("seconds"))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'A' THEN l_quantity * (60 / 1e4) WHEN 'N' THEN l_quantity * (60 / 1e7) ELSE l_quantity END AS percent FROM lineitem
""")
def unit_normalise(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "mM").when(F.col("l_returnflag") == "N", "µM").otherwise("%")
    percent = S.to_percent(F.col("l_quantity"), unit, S.MOLAR_MASS["acetic"])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", percent.alias("percent"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN round(0.66 * pi() * (p_size / 2.0)::DOUBLE ** 2 * p_retailprice / 10 / (1 + p_partkey % 5) / 100, 5)
  ELSE p_retailprice END AS t0 FROM part
""")
def derived_if_zero(spark: SparkSession, d: str) -> DataFrame:
    t0 = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 0D ELSE p_retailprice END")
    flow = (1 + F.col("p_partkey") % 5).cast("double")
    return table(spark, d, "part").select("p_partkey", S.dead_time(t0, F.col("p_size"), F.col("p_retailprice"), flow).alias("t0"))


@query("SELECT p_partkey, p_retailprice, p_type, p_brand, p_name FROM part")
def move_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns put right after another; their order is what counts, and names tell it."""
    moved = C.move_next_to(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"), ["p_brand", "p_type"], "p_partkey")
    assert moved.columns == ["p_partkey", "p_brand", "p_type", "p_name", "p_retailprice"]
    return moved


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def prune_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.prune_columns(table(spark, d, "part"), [r"_brand$", "type", "^p_size"])


@query("""
SELECT c_custkey, (s IS NOT DISTINCT FROM 'AUTOMOBILE')::DOUBLE AS seg_AUTOMOBILE, (s IS NOT DISTINCT FROM 'BUILDING')::DOUBLE AS seg_BUILDING,
  (s IS NOT DISTINCT FROM 'FURNITURE')::DOUBLE AS seg_FURNITURE, (s IS NOT DISTINCT FROM 'HOUSEHOLD')::DOUBLE AS seg_HOUSEHOLD,
  (s IS NOT DISTINCT FROM 'MACHINERY')::DOUBLE AS seg_MACHINERY, (s IS NULL)::DOUBLE AS seg_nan
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)
""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END").alias("seg"))
    return C.one_hot(rows, "seg").drop("seg")


@query(f"SELECT p_partkey, coalesce({NULLED}, 0) AS price FROM part")
def fill_const(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_const(part_with_nulls(spark, d), 0, ["price"]).select("p_partkey", "price")


@query("SELECT event_id, TRY_CAST(props AS DOUBLE) AS whole, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS digits FROM events")
def try_numeric(spark: SparkSession, d: str) -> DataFrame:
    digits = F.regexp_extract("props", "[0-9]+", 0)
    return table(spark, d, "events").select("event_id", S.numeric(F.col("props")).alias("whole"), S.numeric(digits).alias("digits"))


@query("SELECT event_id, round(ln(1 + value), 9) AS logged, round(exp(ln(1 + value)) - 1, 6) AS back FROM events")
def log_transform(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(F.log1p("value"), 9).alias("logged"), F.round(F.expm1(F.log1p("value")), 6).alias("back"))


@query("""
SELECT p.p_partkey, coalesce(a.p_name, b.p_type, p.p_brand) AS representation FROM part p
LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0) a USING (p_partkey)
LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_partkey % 3 = 0) b USING (p_partkey)
""")
def coalesce_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    a = part.filter("p_partkey % 2 = 0").select("p_partkey", "p_name")
    b = part.filter("p_partkey % 3 = 0").select("p_partkey", "p_type")
    rows = part.select("p_partkey", "p_brand").join(a, "p_partkey", "left").join(b, "p_partkey", "left")
    return rows.select("p_partkey", F.coalesce("p_name", "p_type", "p_brand").alias("representation"))


TYPED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END"


@query(f"SELECT event_id, event_type, value FROM (SELECT event_id, {TYPED} AS event_type, value FROM events) WHERE event_type IS DISTINCT FROM 'view' OR value >= 20")
def partition_threshold(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = C.partition_threshold(table(spark, d, "events").withColumn("event_type", F.expr(TYPED)), "event_type", "view", "value", 20.0)
    return kept.select("event_id", "event_type", "value")


@query("SELECT count(*) FILTER (WHERE p) AS kept, count(*) FILTER (WHERE NOT p) AS dropped FROM (SELECT event_type <> 'view' OR value >= 20 AS p FROM events)")
def partition_threshold_report(spark: SparkSession, d: str) -> DataFrame:
    return C.partition_threshold(table(spark, d, "events"), "event_type", "view", "value", 20.0)[1]


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side
FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) a
FULL JOIN (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size < 25) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def key_symdiff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    b = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("k"))
    return C.only_in_one(a, b, "k")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def min_group_size(spark: SparkSession, d: str) -> DataFrame:
    return C.min_group_size(table(spark, d, "orders"), "o_custkey", 12).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 12")
def min_group_size_dropped(spark: SparkSession, d: str) -> DataFrame:
    return C.small_groups(table(spark, d, "orders"), "o_custkey", 12)


@query("""
SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT (trunc(l_discount * 12) <> 0 OR trunc(l_tax * 20) <> 0)
""")
def any_nonzero(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumns({"_a": F.col("l_discount") * 12, "_b": F.col("l_tax") * 20})
    return C.drop_any_nonzero(rows, ["_a", "_b"]).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


def order_segments(spark: SparkSession, d: str) -> DataFrame:
    return C.segment_counts(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 6")
def segment_upper(spark: SparkSession, d: str) -> DataFrame:
    return C.segment_upper(order_segments(spark, d), 6).select("l_orderkey", "n")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def segment_lower(spark: SparkSession, d: str) -> DataFrame:
    return C.segment_lower(order_segments(spark, d)).select("l_orderkey", "n")


@query(f"SELECT p_partkey, p_brand FROM part WHERE {NULLED} IS NOT NULL")
def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    return part_with_nulls(spark, d).na.drop(subset=["price"]).select("p_partkey", "p_brand")


@query("SELECT event_id, value FROM events WHERE event_type <> 'click'")
def exclude_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type <> 'click'").select("event_id", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300")
def value_floor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_totalprice > 300").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def reject_group_if_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("t", F.expr("CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END"))
    return C.reject_group_if_null(rows, "o_custkey", "t").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, count(DISTINCT nullif(p_brand, '')) AS n_categories FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT nullif(p_brand, '')) < 3")
def too_few_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return C.too_few_categories(rows, "l_orderkey", "p_brand")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, p.p_brand, s.s_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    line, part, supplier = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    # Dimensions are broadcast by Spark's own threshold, never by hint, so a large one is shuffled.
    rows = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "p_brand", "s_name")


@query("""
SELECT p.p_partkey, coalesce(r.p_brand, p.p_brand) AS p_brand, coalesce(r.p_retailprice, p.p_retailprice) AS p_retailprice FROM part p
LEFT JOIN (SELECT p_partkey, nullif(p_brand || 'x', 'Brand#11x') AS p_brand, CASE WHEN p_size > 25 THEN NULL ELSE p_retailprice * 2 END AS p_retailprice FROM part WHERE p_partkey % 3 = 0) r USING (p_partkey)
""")
def overlay_update(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    newer = part.filter("p_partkey % 3 = 0").select("p_partkey", F.expr("nullif(p_brand || 'x', 'Brand#11x')").alias("p_brand"), F.expr("CASE WHEN p_size > 25 THEN NULL ELSE p_retailprice * 2 END").alias("p_retailprice"))
    return C.overlay(part, newer, "p_partkey", ["p_brand", "p_retailprice"]).drop("p_size")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def anti_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, price, p_size FROM lineitem JOIN (SELECT p_partkey, {NULLED} AS price, p_size FROM part) ON l_partkey = p_partkey WHERE price IS NOT NULL")
def lookup_enrich(spark: SparkSession, d: str) -> DataFrame:
    found = C.lookup_enrich(table(spark, d, "lineitem"), part_with_nulls(spark, d), "l_partkey", "p_partkey", ["price", "p_size"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "price", "p_size")


@query("""
SELECT p.p_partkey, coalesce(a.m, round_even(b.m * 1e9, 0) / 1e9) AS m FROM part p
LEFT JOIN (SELECT p_partkey, p_retailprice AS m FROM part WHERE p_partkey % 2 = 0) a USING (p_partkey)
LEFT JOIN (SELECT p_partkey, p_size / 7.0::DOUBLE AS m FROM part WHERE p_partkey % 3 <> 0) b USING (p_partkey)
""")
def lookup_complete(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    primary = part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_retailprice").alias("m"))
    secondary = part.filter("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") / F.lit(7.0)).alias("m"))
    return C.lookup_complete(part.select("p_partkey"), primary, secondary, "p_partkey", {"m": 9})


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 60 AS t, CASE WHEN f IS NULL OR f < 0 THEN p_retailprice ELSE f END AS flow
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN -l_tax - 1 ELSE l_tax END AS f FROM lineitem) JOIN part ON l_partkey = p_partkey
""")
def conditional_impute_join(spark: SparkSession, d: str) -> DataFrame:
    flow = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN -l_tax - 1 ELSE l_tax END")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("t"), flow.alias("flow"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return C.conditional_impute(rows, part, "l_partkey", "t", "flow", "p_retailprice")


@query(f"SELECT p_partkey, coalesce({NULLED}, (SELECT round_even(avg({NULLED}) * 100, 0) / 100 FROM part)) AS price FROM part")
def impute_global_mean(spark: SparkSession, d: str) -> DataFrame:
    return C.impute_mean(part_with_nulls(spark, d).select("p_partkey", "price"), ["price"])


@query("""
SELECT p_partkey, concat_ws(', ', CASE WHEN p_partkey % 7 = 0 THEN 'price' END, CASE WHEN p_partkey % 5 = 0 THEN 'brand' END) AS missing FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0
""")
def null_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = part_with_nulls(spark, d).withColumn("brand", F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END"))
    return C.null_columns(rows, "p_partkey", ["price", "brand"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT o_orderkey AS k, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON o_orderkey = l_orderkey")
def segment_count(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).join(counts, "k", "left").fillna(0, ["n"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_key(table(spark, d, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer
""")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS balance")
    b = table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS segment")
    return T.union_all([a, b])


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    return a.intersect(table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("k")))


PIVOT = ", ".join(f"max(CASE WHEN i = {i} THEN {c} END) AS {c}_{i}" for i in range(4) for c in ("l_partkey", "l_quantity"))


@query(f"SELECT l_orderkey, {PIVOT} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SEGMENT_SQL}) - 1 AS i FROM lineitem) GROUP BY 1")
def pivot_segments(spark: SparkSession, d: str) -> DataFrame:
    from cohortry.operators.features import pivot_segments as pivot

    return pivot(C.segments(table(spark, d, "lineitem"), "l_orderkey", SEGMENT_ORDER, [], 4), "l_orderkey", ["l_partkey", "l_quantity"], 4)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sorted_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def best_trial(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(1)


@query("SELECT event_id, value FROM events ORDER BY md5(event_id::VARCHAR || '42'), event_id LIMIT 700")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    from cohortry.operators.splits import order_key

    return table(spark, d, "events").select("event_id", "value").orderBy(order_key("event_id"), "event_id").limit(700)
