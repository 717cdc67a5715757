"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.plans.base import query, rounded, table
from cohortry.sources import tables as T
from cohortry.sources.shared import new_path

REPORT = "SELECT c_nationkey::VARCHAR AS nation, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL"


@query(REPORT)
def tsv_report(spark: SparkSession, d: str) -> DataFrame:
    """A report as one tab-separated file, read back under a schema that keeps keys as text."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    path = new_path(spark, "report")
    T.write_tsv(rounded(rows.agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")), "balance", digits=2), path)
    return T.read_delimited(spark, path, "nation string, segment string, n bigint, balance double")


@query("SELECT 'seg=' || c_mktsegment AS source, c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer")
def multi_source_scan(spark: SparkSession, d: str) -> DataFrame:
    """One folder of text files per source, all read in one scan with the source's name; NaN is null."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN 'NaN' ELSE CAST(c_acctbal AS STRING) END").alias("balance"))
    path = new_path(spark, "sources")
    rows.write.partitionBy("seg").csv(path, sep="\t", header=True)
    return T.read_sources(spark, f"{path}/*/*.csv", "k bigint, balance double", "source").select("source", "k", "balance")


#: Each source's columns in an order of its own; FURNITURE lacks one, HOUSEHOLD has one that no schema names.
LAYOUTS = {"BUILDING": ["name", "k", "balance"], "FURNITURE": ["name", "k"], "HOUSEHOLD": ["phone", "balance", "k", "name"]}


def sources_of_many_layouts(spark: SparkSession, d: str) -> str:
    """The pattern of text files, a folder per source, whose headers differ."""
    path = new_path(spark, "layouts")
    rows = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN 'NaN' ELSE CAST(c_acctbal AS STRING) END").alias("balance"), F.lit("0").alias("phone")
    )
    named = rows.filter(F.col("seg").isin(list(LAYOUTS)))
    for seg, columns in LAYOUTS.items():
        named.filter(F.col("seg") == seg).select(*columns).write.csv(f"{path}/seg={seg}", sep="\t", header=True)
    rows.filter(~F.col("seg").isin(list(LAYOUTS))).select("seg", "k", "balance", "name").write.mode("append").partitionBy("seg").csv(path, sep="\t", header=True)
    return f"{path}/*/*.csv"


@query("""
SELECT 'seg=' || c_mktsegment AS source, c_custkey AS k, CASE WHEN c_custkey % 9 = 0 OR c_mktsegment = 'FURNITURE' THEN NULL ELSE c_acctbal END AS balance, c_name AS name FROM customer
""")
def sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose columns come in different orders, of which one lacks a column and one has another, as one table."""
    return T.read_sources(spark, sources_of_many_layouts(spark, d), "k bigint, balance double, name string", "source").select("source", "k", "balance", "name")


@query("SELECT DISTINCT 'seg=' || c_mktsegment AS source, CASE c_mktsegment WHEN 'FURNITURE' THEN 'balance' ELSE 'phone' END AS \"column\", CASE c_mktsegment WHEN 'FURNITURE' THEN 'missing' ELSE 'unknown' END AS status FROM customer WHERE c_mktsegment IN ('FURNITURE', 'HOUSEHOLD')")
def source_columns(spark: SparkSession, d: str) -> DataFrame:
    """What sources have that no schema names, and what they lack."""
    return T.column_report(spark, sources_of_many_layouts(spark, d), "k bigint, balance double, name string").distinct()


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click'")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """Events in a folder per type, of which one is read."""
    path = new_path(spark, "by-type")
    T.write_partitioned(table(spark, d, "events").select("event_id", "event_type", "value"), path, "event_type")
    return spark.read.parquet(path).filter("event_type = 'click'").select("event_id", "event_type", "value")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def build_if_missing(spark: SparkSession, d: str) -> DataFrame:
    """A table that is built once; the second builder is never asked."""
    path = new_path(spark, "built")
    T.build_if_missing(spark, path, lambda: table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")))
    return T.build_if_missing(spark, path, lambda: spark.range(0).selectExpr("'' AS priority", "id AS n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def build_again_if_changed(spark: SparkSession, d: str) -> DataFrame:
    """A table that is built again once a file that it was built from has changed."""
    source, path = new_path(spark, "inputs"), new_path(spark, "built")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows.filter("o_orderkey % 2 = 0").write.parquet(source)
    build = lambda: spark.read.parquet(source).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    T.build_if_missing(spark, path, build, [source])
    rows.filter("o_orderkey % 2 <> 0").write.mode("append").parquet(source)
    return T.build_if_missing(spark, path, build, [source])


@query("SELECT o_orderkey, o_orderkey * 61 + 0.5::DOUBLE AS seconds FROM orders")
def duration_text(spark: SparkSession, d: str) -> DataFrame:
    """Durations as text, such as 1 days 02:03:04.5, to seconds."""
    s = F.col("o_orderkey") * 61
    text = F.format_string("%d days %02d:%02d:%02d.5", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
    return table(spark, d, "orders").select("o_orderkey", S.duration_seconds(text).alias("seconds"))
