"""Sources with identical conditions become one group; replicates within a group become one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.ranks import bucket_of, cuts_of, running
from cohortry.sources.shared import materialize


def merge_conditions(df: DataFrame, key: str, conditions: list[str], prefix: str = "cc_") -> DataFrame:
    """(group_id, conditions, first, n): sources with equal values in all ``conditions``, null being one, share a new id.

    Ids count from 1, shared conditions first, then single sources, each by their smallest key.
    """
    groups = df.select(key, F.struct(*conditions).alias("conditions")).groupBy("conditions").agg(F.count("*").cast("int").alias("n"), F.min(key).alias("first"))
    single = (F.col("n") == 1).cast("int")
    groups = materialize(groups, "conditions")  # read for cuts and for ranks
    step = F.lpad(bucket_of("first", cuts_of(groups, "first")).cast("string"), 6, "0")
    placed = running(groups, [], F.concat(single.cast("string"), step), [single, "first"])
    return placed.select(F.concat(F.lit(prefix), (F.col("_before") + 1).cast("string")).alias("group_id"), "conditions", "first", "n")


def group_members(df: DataFrame, key: str, conditions: list[str], groups: DataFrame) -> DataFrame:
    """(group_id, key): a row for each source, however many share conditions."""
    rows = df.select(key, F.struct(*conditions).alias("conditions"))
    return rows.join(groups.select("group_id", "conditions"), "conditions").select("group_id", key)


def entity_merge(df: DataFrame, key: str, conditions: list[str], prefix: str = "cc_") -> DataFrame:
    """(group_id, members, n): a report that lists each group's sources in one cell."""
    groups = merge_conditions(df, key, conditions, prefix)
    listed = group_members(df, key, conditions, groups).groupBy("group_id").agg(F.array_sort(F.collect_list(key)).alias("members"))
    return listed.join(groups.select("group_id", "n"), "group_id").select("group_id", "members", "n")


def remap_key(df: DataFrame, members: DataFrame, key: str, new_key: str = "group_id") -> DataFrame:
    """``df`` under the id of its group (``members``: group_id, key); of a group's rows the one with the smallest key stays."""
    rows = df.join(members.select(F.col("group_id").alias("_g"), key), key)
    first = rows.groupBy("_g").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), key).alias("_r"))
    return first.select(F.col("_g").alias(new_key), "_r.*")


def group_max_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Attach the group's greatest and mean value; counted with map-side combination and joined."""
    stats = df.groupBy(group).agg(F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))
    return df.join(stats, group)


def replicates(df: DataFrame, group: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """(rows of entities that occur once in a group, rows of those that recur); null entities are in neither."""
    counts = df.groupBy(group, entity).agg(F.count("*").alias("_n"))
    rows = df.join(counts, [group, entity])
    return rows.filter("_n = 1").drop("_n"), rows.filter("_n > 1").drop("_n")


def replicate_sets(df: DataFrame, group: str, entity: str, value: str, threshold: float = 0.025) -> DataFrame:
    """One row per recurring (group, entity): n, low, high, mean, limit, kept.

    A set whose range is over ``threshold`` of the group's greatest value is dropped; a range
    equal to it stays.  The greatest value is over all rows of the group, dropped ones too.
    """
    top = df.groupBy(group).agg((F.max(value) * threshold).alias("limit"))
    known = df.filter(F.col(entity).isNotNull())
    sets = known.groupBy(group, entity).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return sets.join(top, group).withColumn("kept", ~((F.col("high") - F.col("low")) > F.col("limit")))


def reconcile(df: DataFrame, group: str, entity: str, value: str, threshold: float = 0.025) -> DataFrame:
    """(group, entity, value, n): single rows as they are, agreeing replicates as their mean."""
    sets = replicate_sets(df, group, entity, value, threshold)
    return sets.filter((F.col("n") == 1) | F.col("kept")).select(group, entity, F.col("mean").alias(value), "n")


def reconcile_summary(df: DataFrame, group: str, entity: str, value: str, threshold: float = 0.025) -> DataFrame:
    """Rows: total, in replicate sets, treated (kept sets), dropped, remaining."""
    sets = replicate_sets(df, group, entity, value, threshold)
    many, kept = F.col("n") > 1, F.col("kept")
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    return sets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        total(many, F.col("n")).alias("replicate_rows"),
        F.count_if(many & kept).alias("sets_kept"),
        F.count_if(many & ~kept).alias("sets_dropped"),
        total(many & ~kept, F.col("n")).alias("rows_dropped"),
        F.count_if(~many | kept).alias("rows_remaining"),
    )
