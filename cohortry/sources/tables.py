"""Sources and sinks."""

from __future__ import annotations

import csv
import hashlib
import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.shared import file_system


#: Different headers that one scan may have; each is a scan of its own files.
MOST_HEADERS = 1000


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header): the first line of each text file that has one.

    A pass over the text that keeps one line a file; only a file's first block is looked at.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.select("file", F.regexp_replace("header", "^\ufeff", "").alias("header"))


def folder_of(path: Column) -> Column:
    """The folder that a file is in, by its name; paths in metadata are percent-encoded."""
    return F.url_decode(F.replace(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))


def split_header(header: str, sep: str = "\t") -> list[str]:
    """Names of a header; a name that recurs gets a number, so that the first keeps it."""
    names, seen = next(csv.reader([header], delimiter=sep), []), {}
    out = []
    for n in names:
        out.append(f"{n}.{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_by_name(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = "\t", source: str | None = None) -> DataFrame:
    """Delimited files with headers, whose columns are found by name, as one table of ``schema``.

    Files are grouped by header; each group is one scan with the names in its own order, which reads
    the wanted columns alone, and the scans are united.  A column that a file lacks is null, one that ``schema``
    lacks isn't read (``column_report`` lists both), and a file without a line has no rows.  ``source``
    adds the name of the folder that a file is in.
    """
    wanted = _schema(schema)
    types = {f.name: f.dataType for f in wanted}
    groups = headers(spark, path).groupBy("header").agg(F.collect_list("file").alias("files")).limit(MOST_HEADERS + 1).collect()  # names of files, which the driver lists anyway
    if len(groups) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} different headers: {path}")
    out = spark.createDataFrame([], T.StructType(([T.StructField(source, T.StringType())] if source else []) + wanted.fields))
    for g in sorted(groups, key=lambda g: g.header):
        names = split_header(g.header, sep)
        own = T.StructType([T.StructField(f"_{k}", types.get(n, T.StringType())) for k, n in enumerate(names)])
        files = [re.sub(r"([*?{}\[\]\\])", r"\\\1", unquote(f)) for f in sorted(g.files)]
        rows = spark.read.csv(files, schema=own, sep=sep, header=True)
        folder = [folder_of(F.col("_metadata.file_path")).alias(source)] if source else []
        columns = [(F.col(f"_{names.index(c)}") if c in names else F.lit(None).cast(t)).alias(c) for c, t in types.items()]
        out = out.unionByName(rows.select(*folder, *columns))
    return nan_to_null(out)


def column_report(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """(source, column, status) of the columns that a source has and ``schema`` doesn't name (unknown), or the other way round (missing)."""
    known = _schema(schema).names
    found = headers(spark, path)
    distinct = [r.header for r in found.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(distinct) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} different headers: {path}")
    rows = []
    for h in distinct:
        names = split_header(h, sep)
        rows += [(h, c, "unknown") for c in names if c not in known] + [(h, c, "missing") for c in known if c not in names]
    odd = spark.createDataFrame(rows, "header string, column string, status string")
    return found.join(F.broadcast(odd), "header").select(folder_of(F.col("file")).alias("source"), "column", "status")  # at most MOST_HEADERS headers


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """A delimited file, or a folder of them, with a header; columns are found by name, and the schema keeps identifiers as text."""
    return read_by_name(spark, path, schema, sep)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.nanvl(f"`{c}`", F.lit(None).cast("double")) for c in floats}) if floats else df


def read_sources(spark: SparkSession, pattern: str, schema: T.StructType | str, source: str = "dir_id", sep: str = "\t") -> DataFrame:
    """One file per source in a folder named after it, whatever the order of its columns, with the source's name."""
    return read_by_name(spark, pattern, schema, sep, source)


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables under all their columns; absent cells are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder per category, so that later reads of one category read only it.

    Spark evens the rows out over tasks and keeps a category's together where they fit, so a
    hot category becomes several files and no single task.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """One tab-separated file; for reports, which are small.  What makes the report keeps its own tasks."""
    df.repartition(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_folds(df: DataFrame, path: str, fold: str = "fold") -> DataFrame:
    """One folder per fold; returns the rows of each."""
    write_partitioned(df, path, fold)
    return df.groupBy(fold).agg(F.count("*").alias("n"))


def fold_keys(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """(fold, key, n): the keys of each fold and how many rows each has there."""
    return df.groupBy(fold, key).agg(F.count("*").alias("n"))


def _state(spark: SparkSession, inputs: list[str]) -> str:
    """A digest of the names, sizes and times of the files below ``inputs``; nothing is read."""
    if not inputs:
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs).select("path", "length", "modificationTime")
    h = F.xxhash64("path", "length", "modificationTime")
    n, x, s = files.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()
    return hashlib.sha256(f"{sorted(inputs)} {n} {x} {s}".encode()).hexdigest()


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published at ``path``: the newest of its manifests."""
    fs, at = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    last = max((n for n in names if re.fullmatch(r"_built-[0-9]{8}\.json", n)), default=None)
    if last is None:
        return None
    stream = fs.open(file_system(spark, f"{path}/{last}")[1])
    try:
        return json.loads(bytes(stream.readAllBytes())) | {"number": int(last[7:15])}
    finally:
        stream.close()


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[str] = ()) -> DataFrame:
    """The table that is published at ``path``, built first unless it is there for the files that ``inputs`` hold now.

    A build is written under a name of its own and published by renaming a small manifest, which
    names it and the state of its inputs.  So a build that breaks leaves nothing to be seen; of two builders at once
    the first to publish wins, and both return its table; files that change, come or go make a new
    build, and readers of the old one keep theirs.
    """
    state, found = _state(spark, list(inputs)), _manifest(spark, path)
    if found is None or found["inputs"] != state:
        name = f"build-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{name}")
        fs, temporary = file_system(spark, f"{path}/.{name}.json")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps({"table": name, "inputs": state}).encode()))
        stream.close()
        number = found["number"] + 1 if found else 0
        if not _published(spark, fs, temporary, f"{path}/_built-{number:08d}.json"):  # another builder was first
            fs.delete(temporary, False)
            fs.delete(file_system(spark, f"{path}/{name}")[1], True)
        found = _manifest(spark, path)
    return spark.read.parquet(f"{path}/{found['table']}")


def _published(spark: SparkSession, fs, temporary, final: str) -> bool:
    """Rename unless ``final`` is there; some file systems replace, others refuse."""
    target = file_system(spark, final)[1]
    return not fs.exists(target) and bool(fs.rename(temporary, target))
