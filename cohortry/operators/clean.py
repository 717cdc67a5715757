"""Cleaning: pruning, filling, filters, overlays and lookups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col(f"`{name}`")


def prune_columns(df: DataFrame, patterns: list[str], keep: list[str] = ()) -> DataFrame:
    """Without the columns whose name matches a pattern; decided on the schema, so scans read less."""
    gone = re.compile("|".join(f"(?:{p})" for p in patterns))
    return df.select(*[quoted(c) for c in df.columns if c in keep or not gone.search(c)])


#: Values that ``one_hot`` makes columns of.
MOST_VALUES = 10_000


def one_hot(df: DataFrame, column: str, values: list | None = None) -> DataFrame:
    """``<column>_<value>`` of 0.0 or 1.0 for each value, sorted; null is a value of its own.

    Values are looked up where they aren't given: they become columns, so over ``MOST_VALUES`` of
    them are an error.
    """
    if values is None:
        values = [r[0] for r in df.select(column).distinct().limit(MOST_VALUES + 1).collect()]
        if len(values) > MOST_VALUES:
            raise ValueError(f"{column} has over {MOST_VALUES} values")
    order = sorted(values, key=lambda v: (v is None, v if v is not None else 0))
    return df.withColumns({f"{column}_{'nan' if v is None else v}": F.col(column).eqNullSafe(F.lit(v)).cast("double") for v in order})


def fill_const(df: DataFrame, value, columns: list[str]) -> DataFrame:
    return df.fillna(value, subset=columns)


def impute_mean(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Nulls become the column's mean over all rows, rounded; the means are one broadcast row."""
    means = df.agg(*[(F.rint(F.avg(c) * 10.0**digits) / F.lit(10.0**digits)).alias(f"_mean_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_mean_{c}") for c in columns})
    return filled.drop(*[f"_mean_{c}" for c in columns])


def partition_threshold(df: DataFrame, key: str, partition, score: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of one partition need a score of ``least``; others, of a null partition too, pass.  With a report of (kept, dropped)."""
    passes = ~F.col(key).eqNullSafe(F.lit(partition)) | F.coalesce(F.col(score) >= least, F.lit(False))
    report = df.agg(F.count_if(passes).alias("kept"), F.count_if(~passes).alias("dropped"))
    return df.filter(passes), report


def only_in_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one table has and the other lacks, with the side."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer").filter("_a IS NULL OR _b IS NULL")
    return both.select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def min_group_size(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows.

    Sizes are counted with map-side combination and joined, so a hot group is never
    collected in one window.
    """
    sizes = df.groupBy(group).count().filter(F.col("count") >= least).select(group)
    return df.join(sizes, group, "left_semi")


def small_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """(group, n) of the groups under ``least`` rows."""
    return df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") < least)


def drop_any_nonzero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows in which a column, its fraction cut off, isn't zero; null counts as zero."""
    nonzero = [F.coalesce(quoted(c).cast("bigint"), F.lit(0)) != 0 for c in columns]
    return df.filter(~reduce(lambda a, b: a | b, nonzero))


def segment_counts(df: DataFrame, source: str) -> DataFrame:
    """(source, n): the segments of each source, counted with map-side combination."""
    return df.groupBy(source).agg(F.count("*").alias("n"))


def segments(df: DataFrame, source: str, order: list[str], fields: list[str], most: int) -> DataFrame:
    """(source, segs): the first ``most`` rows of a source as an ordered array of structs.

    Ranks are limited before the shuffle, so a hot source brings ``most`` rows from each task.
    """
    first = df.withColumn("_at", F.row_number().over(Window.partitionBy(source).orderBy(*order))).filter(F.col("_at") <= most)
    return first.groupBy(source).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("segs"))


def segment_upper(counts: DataFrame, most: int = 11) -> DataFrame:
    """Sources with at most ``most`` segments: a segment of index ``most`` drops the source."""
    return counts.filter(F.col("n") <= most)


def segment_lower(counts: DataFrame, least: int = 3) -> DataFrame:
    """Sources that have a segment of index ``least - 1``."""
    return counts.filter(F.col("n") >= least)


def reject_group_if_null(df: DataFrame, group: str, column: str) -> DataFrame:
    """Without the groups that have a null in ``column``."""
    bad = df.filter(F.col(column).isNull()).select(group).distinct()
    return df.join(bad, group, "left_anti")


def too_few_categories(df: DataFrame, group: str, category: str, least: int = 3) -> DataFrame:
    """(group, n_categories) of groups that can't be split; null and '' are no categories."""
    known = F.when(F.col(category) != "", F.col(category))
    return df.groupBy(group).agg(F.count_distinct(known).alias("n_categories")).filter(F.col("n_categories") < least)


def overlay(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells of ``right`` that aren't null replace those of ``left``; further rows of ``right`` don't count."""
    r = right.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    updated = left.join(r, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    return updated.select(*left.columns)


def lookup_enrich(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, columns: list[str]) -> DataFrame:
    """Add columns of a lookup under another key; rows without all of them go."""
    found = lookup.select(F.col(lookup_key).alias(key), *columns).na.drop(subset=columns)
    return df.join(found, key)


def lookup_complete(df: DataFrame, primary: DataFrame, secondary: DataFrame, key: str, digits: dict[str, int]) -> DataFrame:
    """Values of the primary source, else of the secondary one rounded to ``digits``."""
    a = primary.select(key, *[F.col(c).alias(f"_a_{c}") for c in digits])
    b = secondary.select(key, *[F.col(c).alias(f"_b_{c}") for c in digits])
    both = df.join(a, key, "left").join(b, key, "left")
    made = both.withColumns({c: F.coalesce(f"_a_{c}", (F.rint(F.col(f"_b_{c}") * 10.0**n) / F.lit(10.0**n))) for c, n in digits.items()})
    return made.select(*df.columns, *digits)


def conditional_impute(df: DataFrame, conditions: DataFrame, key: str, time: str, value: str, fallback: str) -> DataFrame:
    """``value`` from the condition row where a time is known and the value is null, or it is negative; times become seconds."""
    joined = df.join(conditions.select(key, fallback), key)
    wrong = (F.col(time).isNotNull() & F.col(value).isNull()) | (F.col(value) < 0)
    made = joined.withColumn(value, F.when(wrong, F.col(fallback)).otherwise(F.col(value))).withColumn(time, F.col(time) * 60)
    return made.select(*df.columns)


def null_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, missing): the names of the null columns of each row that has one, in their order."""
    names = F.array_compact(F.array(*[F.when(quoted(c).isNull(), F.lit(c)) for c in columns]))
    return df.select(key, F.array_join(names, ", ").alias("missing")).filter("missing <> ''")


def source_status(expected: DataFrame, found: DataFrame, key: str, detail: str) -> DataFrame:
    """(key, n, status) of each expected source: found, only canonical (no row with ``detail``), or not found."""
    counts = found.groupBy(key).agg(F.count("*").alias("n"), F.count(detail).alias("_d"))
    joined = expected.join(counts, key, "left")
    status = F.when(F.col("n").isNull(), "not found").when(F.col("_d") == 0, "only canonical").otherwise("found")
    return joined.select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


#: Statuses of a source's gradient.  Fixed values.
GRADIENT_OK, GRADIENT_FLOW, GRADIENT_EMPTY, GRADIENT_LOST = "Gradient data ok", "Need flow rate imputation", "Empty data table", "Gradient.tsv not found"


def gradient_status(expected: DataFrame, rows: DataFrame, key: str, time: str, flow: str, files: DataFrame | None = None) -> DataFrame:
    """(key, status, n) of each expected source: its gradient is ok, lacks a flow rate, is empty, or isn't there.

    A gradient without rows, or with a row that lacks its time, is empty, and n, its segments, is 0.
    ``files`` (key) tells sources whose table has no rows from those without one; without it both aren't there.
    """
    seen = rows.groupBy(key).agg(F.count("*").alias("_rows"), F.count_if(F.col(f"`{time}`").isNull()).alias("_no_time"), F.count_if(F.col(f"`{flow}`").isNull()).alias("_no_flow"))
    known = seen if files is None else files.select(key).distinct().join(seen, key, "left")
    met = expected.join(known.withColumn("_known", F.lit(True)), key, "left")
    empty = F.col("_rows").isNull() | (F.col("_no_time") > 0)
    status = F.when(F.col("_known").isNull(), GRADIENT_LOST).when(empty, GRADIENT_EMPTY).when(F.col("_no_flow") > 0, GRADIENT_FLOW).otherwise(GRADIENT_OK)
    return met.select(key, status.alias("status"), F.when(empty | F.col("_known").isNull(), F.lit(0)).otherwise(F.col("_rows")).cast("long").alias("n"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def move_next_to(df: DataFrame, columns: list[str], anchor: str) -> DataFrame:
    """The same columns, with ``columns`` right after ``anchor``, in the order given."""
    rest = [c for c in df.columns if c not in columns]
    at = rest.index(anchor) + 1
    return df.select(*[quoted(c) for c in [*rest[:at], *columns, *rest[at:]]])
