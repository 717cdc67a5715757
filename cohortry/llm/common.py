"""What the corpus operators share: row keys, salted joins, and the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import Scratch, file_system, materialize, new_path, shared_dir  # noqa: F401  for the operators

#: Runs of these characters count as one space wherever texts are split into words.
SPACES = r"[\x20\x09-\x0D]+"
#: Hot keys are dealt over so many salts before a join or a grouping.
SALTS = 64


def parts_for(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions so that each holds about ``per_part`` rows; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def keyed(docs: DataFrame, key: str = "doc_id", row: str = "_row") -> DataFrame:
    """Add ``row``: a long that is unique, never null, and ascends with ``key`` (null keys last).

    Where ``key`` itself is unique and whole it is used as it is.  Otherwise the rows are
    sorted by range and numbered once, and written, so that the numbers never change; rows of
    one id, however many, are dealt by a hash of all their columns.
    """
    n, whole, distinct = docs.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if n == whole == distinct:
        return docs.withColumn(row, F.col(key).cast("long"))
    order = [F.col(key).asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])]
    numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    return materialize(numbered, "keyed")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns_of(df: DataFrame) -> list:
    """Columns of ``df`` by name, dots and all."""
    return [F.col(f"`{c}`") for c in df.columns]


def salt(*columns: str, salts: int = SALTS):
    """A salt from columns that differ between the rows of one key."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(salts)).cast("int")


def attach(rows: DataFrame, table: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` (many of one key, perhaps a third of all) with ``table`` (one row a key).

    ``spread`` is a column of ``rows`` that differs within a key.  The keys and salts that
    occur are listed first (at most SALTS rows a key), given the columns of ``table``, and
    joined on key and salt, so that no task gets more than its share of a hot key.
    """
    salted = rows.withColumn("_salt", salt(spread))
    places = salted.select(*on, "_salt").groupBy(*on, "_salt").agg(F.count("*").alias("_n")).drop("_n")
    spread_table = places.join(table, on)
    return salted.join(spread_table, [*on, "_salt"], how).drop("_salt")


def words_count(text):
    """Words of a text column, for the whole text; null and blank texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
