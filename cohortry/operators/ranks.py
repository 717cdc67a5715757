"""Ranks and running sums within groups of any size.

A window over a group is one task.  Here a bucket, which never falls along the order, cuts a
group into parts: bucket sums are aggregated with map-side combination, added up over the
buckets of a group, and joined back, so that a window runs over one bucket at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a random order that make its buckets, and buckets of other orders.
DIGITS, BUCKETS = 3, 4096
#: Rows that are worth a bucket of their own, where the number of buckets isn't given.
PER_BUCKET = 1024
#: Cuts that are compared at once on the way to a value's bucket.
FAN = 16
#: Characters of a text that a cut keeps; texts that agree in as many are one bucket.
CUT_CHARS = 128


def hex_bucket(key: Column | str, digits: int = DIGITS) -> Column:
    """The bucket of an order by random hexadecimal digits, such as md5."""
    return F.substring(key, 1, digits)


def cuts_of(df: DataFrame, column: str, buckets: int | None = None) -> list:
    """Ascending cuts between buckets of about equally many rows of ``df``, for numbers and texts alike.

    Numbers are cut at quantiles of a sketch that is merged over tasks; texts at every so manieth of the
    rows whose hash is small, some sixteen a bucket, which are few whatever ``df`` holds.  Outliers and common
    prefixes make no difference; only equal values share a bucket.  A group's part of a bucket is at
    most the bucket, so a hot group has as many buckets as its share of the rows.  Without ``buckets`` there are up
    to ``BUCKETS``, of ``PER_BUCKET`` rows or more: the look-up of a cut costs more than a window over as many rows.
    """
    most = buckets or BUCKETS
    number = lambda n: buckets or min(BUCKETS, 1 + n // PER_BUCKET)
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType | T.DateType | T.TimestampType):
        x = F.col(column).cast("double")
        n, found = df.agg(F.count(x), F.percentile_approx(x, F.lit([k / most for k in range(1, most)]), F.lit(4 * most))).first()
        taken = [found[k * most // number(n) - 1] for k in range(1, number(n))] if found else []
        return sorted({v for v in taken if v == v})
    wanted = 16 * most
    x = F.col(column).cast("string")
    rows = df.agg(F.approx_count_distinct(x)).first()[0]
    some = df.select(x.alias("x")).distinct() if rows <= wanted else df.select(x.alias("x")).distinct().filter(F.pmod(F.xxhash64("x"), F.lit(rows)) < wanted)
    found = sorted({r.x for r in some.select(F.left("x", F.lit(CUT_CHARS)).alias("x")).filter("x IS NOT NULL").collect()}, key=lambda t: t.encode())
    step = max(1, len(found) // number(rows))
    return found[step::step][: number(rows)]


def bucket_of(column: str, cuts: list) -> Column:
    """The bucket of a value: the number of cuts up to it; null is in the first."""
    if not cuts:
        return F.lit(0)
    number = not isinstance(cuts[0], str)
    x = F.col(column).cast("double" if number else "string")

    def level(step: int, at: Column | None) -> Column:
        """Of the cuts, every ``step``-th from place ``at``, how many are no greater."""
        some = F.from_json(F.lit(json.dumps(cuts[step - 1 :: step])), "array<double>" if number else "array<string>")  # folded to one constant
        part = some if at is None else F.slice(some, at + 1, FAN)
        return F.size(F.filter(part, lambda c: c <= x))

    step, place = 1, None
    while FAN * step < len(cuts):
        step *= FAN
    while step:
        found = level(step, place if place is None else place * FAN)
        place = found if place is None else place * FAN + found
        step //= FAN
    return F.coalesce(place, F.lit(0)).cast("int")


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], value: Column | None = None) -> DataFrame:
    """Add ``_before`` and ``_total``: sums of ``value`` (1 if None) over the earlier rows of the group, and over all.

    ``order`` is total, and ``bucket`` ascends with it; null is a group of its own.
    """
    g = F.struct(*[F.col(f"`{g}`") for g in group]) if group else F.lit(0)
    rows = df.withColumns({"_g": g, "_bucket": bucket, "_value": F.lit(1) if value is None else value})
    sums = rows.groupBy("_g", "_bucket").agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy("_g")
    base = sums.select(
        "_g",
        "_bucket",
        F.coalesce(F.sum("_sum").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sum").over(w).alias("_total"),
    )
    inside = Window.partitionBy("_g", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(base, ["_g", "_bucket"])
    met = met.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], "_before", "_total")


def tile(before: Column, total: Column, k: int) -> Column:
    """The part, from 0, of a row with ``before`` rows in front of it where ``total`` rows are cut into k, the larger parts first."""
    size, larger = F.floor(total / k), total % k
    head = larger * (size + 1)
    return F.when(before < head, F.floor(before / (size + 1))).otherwise(larger + F.floor((before - head) / F.greatest(size, F.lit(1)))).cast("int")
