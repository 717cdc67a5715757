"""Exact deduplication against a persistent digest index.

The index has one row per distinct text, bucketed and sorted by the text's digest.  New data
are reduced to one candidate per digest, anti-joined with the index by sort-merge (the index
side is read bucket by bucket and never shuffled, nor sorted while each bucket is one file),
and what is left is appended.  DataFrame operations only.

An index lives in a folder.  Each append is a subfolder with files of all buckets, and the
newest manifest lists the subfolders that count, so a later session opens the index by its folder
alone, and what a broken write left is never read.  ``compact`` writes one subfolder with one
sorted file a bucket and then the manifest that names it alone.  One writer at a time.

A batch has a name, given by the caller or made from its documents.  Texts that the index holds
under the same name are the batch's own, so a call that is repeated, or taken up again after a
failure at any point, gives the rows of the first one.

Defined results: a null text counts as empty; texts are equal if they are so after each run
of spaces is replaced by one space; of equal texts the smallest ``doc_id`` stays (null ids
come last); of rows that repeat the same id and text exactly one stays; long texts count whole;
an empty table gives an empty result; further columns, of any name, are ignored by ``decisions``
and kept by ``deduplicate``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import SPACES, attach, columns_of, file_system, free_name, keyed, materialize, new_path

#: Appends after which an index is compacted.
COMPACT_AFTER = 8


def text_sha256(text):
    """Lowercase hex digest of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within the block, a scan of buckets of one sorted file each goes without a sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class DigestIndex:
    """The digest index of a folder, opened if it is there and else created by the first append.

    Columns: digest binary, first_row long, first_id long, batch string (the row, document and
    batch that brought the text).  ``buckets`` is fixed when the index is created; it should grow
    with the corpus, at 100 TB some tens of thousands.  Without a folder the index is a new one
    in the shared folder.
    """

    COLUMNS = "digest binary, first_row bigint, first_id bigint, batch string"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path or new_path(spark, "digest-index"), compact_after
        found, self._named = self._manifests(), {}
        if found:
            fs, at = file_system(spark, f"{self.path}/{found[-1]}")
            stream = fs.open(at)
            self.manifest = json.loads(bytes(stream.readAllBytes()))
            stream.close()
        else:
            buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
            self.manifest = {"appends": [], "buckets": buckets, "bucketed_by": "digest", "sorted_by": "digest"}

    def _manifests(self) -> list[str]:
        fs, at = file_system(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if re.fullmatch(r"manifest-[0-9]{8}\.json", n))

    def _publish(self, appends: list[str]) -> None:
        """Write the next manifest under another name first, so that readers see it whole or not at all."""
        found, manifest = self._manifests(), self.manifest | {"appends": appends}
        number = int(found[-1][9:17]) + 1 if found else 0
        fs, at = file_system(self.spark, f"{self.path}/.manifest-{uuid.uuid4().hex}")
        stream = fs.create(at, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, final = file_system(self.spark, f"{self.path}/manifest-{number:08d}.json")
        if not fs.rename(at, final):
            raise OSError(f"{final} exists: the index has another writer")
        self.manifest = manifest

    def parts(self) -> list[DataFrame]:
        """The appends that count, each a table of sorted buckets; a digest is in one of them."""
        out = []
        for name in self.manifest["appends"]:
            if name not in self._named:  # in this session's catalog
                self._named[name] = f"digest_index_{uuid.uuid4().hex}"
                self.spark.sql(
                    f"CREATE TABLE {self._named[name]} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.manifest['buckets']} BUCKETS LOCATION '{self.path}/{name}'"
                )
            out.append(self.spark.table(self._named[name]))
        return out

    def rows(self) -> DataFrame:
        """All rows of the index."""
        folders = [f"{self.path}/{name}" for name in self.manifest["appends"]]
        return self.spark.read.schema(self.COLUMNS).parquet(*folders) if folders else self.spark.createDataFrame([], self.COLUMNS)

    def known(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` (one a digest) whose text the index has, with its columns."""
        # One side is dealt by bucket for all joins; the index is read in place.
        return reduce(DataFrame.unionByName, [digests.join(p.hint("merge"), "digest") for p in self.parts()])

    def _write(self, rows: DataFrame) -> str:
        """Bucketed files of ``rows`` in a new subfolder; each task has one bucket, sorted."""
        n, name = self.manifest["buckets"], f"append-{uuid.uuid4().hex}"
        table = f"digest_index_{uuid.uuid4().hex}"
        rows.repartition(n, "digest").write.format("parquet").bucketBy(n, "digest").sortBy("digest").option("path", f"{self.path}/{name}").saveAsTable(table)
        self._named[name] = table
        return name

    def append_new(self, rows: DataFrame, batch: str) -> None:
        """Append the digests of ``rows`` (_row, doc_id, digest) that the index lacks.

        A group of equal texts is reduced to its first row before anything is shuffled.
        """
        fresh = rows.groupBy("digest").agg(F.min("_row").alias("first_row"), F.min_by("doc_id", "_row").alias("first_id"))
        for p in self.parts():
            fresh = fresh.join(p.hint("merge"), "digest", "left_anti")
        with _sorted_buckets(self.spark):
            name = self._write(fresh.select("digest", "first_row", "first_id", F.lit(batch).alias("batch")))
        self._publish([*self.manifest["appends"], name])
        if len(self.manifest["appends"]) > self.compact_after:
            self.compact()

    def compact(self) -> None:
        """One subfolder with one sorted file for each bucket; whatever else is there is deleted last."""
        self._publish([self._write(self.rows())])  # by files, not by buckets, whose scan would be split over tasks
        fs, at = file_system(self.spark, self.path)
        for f in fs.listStatus(at):
            if f.isDirectory() and f.getPath().getName() not in self.manifest["appends"]:
                fs.delete(f.getPath(), True)


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, doc_id, digest) of each row, written once so that texts are hashed once."""
    rows = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_sha256(F.col(text))).alias("digest"))
    return materialize(rows, "digests")


def batch_name(rows: DataFrame) -> str:
    """A name that the same rows (_row, digest) have again, in any order."""
    h = F.xxhash64("_row", "digest")
    return "-".join(str(x) for x in rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20)), F.max("_row")).first())


def decisions(docs: DataFrame, index: DigestIndex | None = None, increments: int = 2, batch: str | None = None) -> DataFrame:
    """One row per document: _row, doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` carries ``_row`` (see ``keyed``).  The documents reach the index in
    ``increments`` ascending ranges of ``_row``, as a corpus that grows would.  A text that
    ``index`` holds from another batch keeps no row of ``docs``: its keep_id is the earlier id.
    A name is for one set of documents; without one, these documents' own is used.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = digested(docs)
    batch = batch or batch_name(rows)
    low, high = rows.agg(F.min("_row"), F.max("_row")).first()
    low, high = low or 0, high or 0
    cuts = [low + (high - low) * k // increments for k in range(1, increments)]
    for k in range(increments):
        some = rows
        if k:
            some = some.filter(F.col("_row") > cuts[k - 1])
        if k < increments - 1:
            some = some.filter(F.col("_row") <= cuts[k])
        index.append_new(some, batch)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min("_row").alias("own_row"), F.min_by("doc_id", "_row").alias("own_id"))
    own = F.col("batch") == batch
    known = index.known(sizes).select("digest", "group_size", F.when(own, F.col("own_row")).alias("keep_row"), F.when(own, F.col("own_id")).otherwise(F.col("first_id")).alias("keep_id"))
    with _sorted_buckets(spark):
        known = materialize(known, "known-digests")
    found = attach(rows, known, ["digest"], "_row")
    kept = F.coalesce(F.col("_row") == F.col("keep_row"), F.lit(False))
    return found.select("_row", "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """``docs`` without the rows whose text an earlier row or the index has; same columns."""
    row = free_name(docs, "_row")
    rows = keyed(docs, row=row)
    stay = decisions(rows.select(F.col(row).alias("_row"), "doc_id", "text"), index, batch=batch).filter("kept").select(F.col("_row").alias(row))
    return rows.join(stay, row, "left_semi").select(*columns_of(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decisions(keyed(docs)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
