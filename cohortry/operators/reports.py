"""Reports: totals, waterfalls, comparisons, status of rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortry.sources.shared import materialize


def group_count_total(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group and a Total row, which ``is_total`` tells from a null group."""
    rows = df.rollup(group).agg(F.count("*").alias("n"), F.grouping(group).cast("int").alias("is_total"))
    return rows.select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col(group).cast("string")).alias("group_key"), "n", "is_total")


def status_counts(df: DataFrame, group: str, status: str, rejected: str) -> DataFrame:
    """(group, retained, rejected) of the groups with a rejected row."""
    bad = F.col(status) == rejected
    return df.groupBy(group).agg(F.count_if(~bad).alias("retained"), F.count_if(bad).alias("rejected")).filter("rejected > 0")


def waterfall(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(position, stage, dropped): rows lost from each table to the next, and their total.

    ``stages`` are the table after each step, the first the input.
    """
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("position"), F.lit(name).alias("stage"), "n") for k, (name, t) in enumerate(stages)]
    rows = reduce(DataFrame.unionAll, counts)
    before = rows.select((F.col("position") + 1).alias("position"), F.col("n").alias("before"))
    lost = rows.join(F.broadcast(before), "position").select("position", "stage", (F.col("before") - F.col("n")).alias("dropped"))
    total = lost.agg(F.lit(len(stages)).alias("position"), F.lit("total").alias("stage"), F.sum("dropped").alias("dropped"))
    return lost.unionAll(total)


def flow(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(what the stages leave, (position, stage, dropped)): the waterfall of a run, counted while its rows flow.

    The stages are applied one to the other and the result is written once; counters in between
    see each stage's rows on the way, so no stage runs again for its count.  Where a lost executor makes Spark run
    tasks again, counters see those rows again; then stages are counted from written tables by ``waterfall``.
    """
    seen = [Observation(f"stage-{k}") for k in range(len(stages) + 1)]
    count = F.count(F.lit(1)).alias("n")
    now = df.observe(seen[0], count)
    for (_, stage), counter in zip(stages, seen[1:], strict=True):
        now = stage(now).observe(counter, count)
    out = materialize(now, "flow")
    counts = [c.get.get("n", 0) for c in seen]
    rows = [(k, name, counts[k - 1] - counts[k]) for k, (name, _) in enumerate(stages, 1)]
    report = df.sparkSession.createDataFrame([*rows, (len(stages) + 1, "total", counts[0] - counts[-1])], "position int, stage string, dropped long")
    return out, report


def run_comparison(metrics: DataFrame, run: str = "run", names: list[str] = ("mae", "rmse")) -> DataFrame:
    """One row per run with mean and deviation of each metric, from (run, metric, mean, std)."""
    return metrics.groupBy(run).pivot("metric", list(names)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def summary_with_total(keys: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows that each table has of each key all tables know, and a Total row."""
    joined = keys.select(key)
    for name, table in tables.items():
        joined = joined.join(table.groupBy(key).agg(F.count("*").alias(name)), key)
    rows = joined.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *[F.sum(n).alias(n) for n in tables])
    return rows.select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col(key).cast("string")).alias("source"), *tables)


def totals_by_method(summary: DataFrame, method: str, key: str, count: str) -> DataFrame:
    """(method, source, count): the rows of each method and its Total; null methods are one."""
    rows = summary.groupBy(method, key).agg(F.sum(count).alias(count))
    per = rows.groupBy(method).agg(F.sum(count).alias(count)).select(method, F.lit("Total").alias("source"), count)
    return rows.select(method, F.col(key).cast("string").alias("source"), count).unionByName(per)


def unusable_sources(counts: DataFrame, status: DataFrame, key: str, count: str, unusable: list[str]) -> DataFrame:
    """(source, count): the sources of ``counts`` (key, count) that have no usable status, and their Total, 0 if there are none."""
    usable = status.filter(~F.col("status").isin(unusable)).select(key)
    left = counts.join(usable, key, "left_anti").select(F.col(key).cast("string").alias("source"), count)
    return left.unionByName(left.agg(F.lit("Total").alias("source"), F.coalesce(F.sum(count), F.lit(0)).alias(count)).select("source", count))


def dropped_names(names: list[str], df: DataFrame, column: str = "dropped") -> DataFrame:
    """A one-column report of names, such as those of pruned columns."""
    return df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")


def dropped_keys(before: DataFrame, after: DataFrame, key: str, column: str = "dropped") -> DataFrame:
    """A one-column report of the keys that have no row left, as text."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias(column))
