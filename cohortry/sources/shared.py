"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse is used if driver and executors are one
    process (tests, a laptop); on a cluster it is an error, since tasks would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for the few files that the driver handles."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Scratch:
    """Tables written within a ``with`` block are deleted when it ends well, but for what ``keep`` names.

    For callers that are done with an operator's result, such as a pipeline whose stage has
    been written.  A lazy result reads the tables of its own block, so it can't leave it.
    """

    #: Of this thread, the innermost last.
    _open: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    @classmethod
    def blocks(cls) -> tuple[Scratch, ...]:
        return cls._open.get()

    def __enter__(self) -> Scratch:
        Scratch._open.set((*Scratch.blocks(), self))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that ``materialize`` returned is left to the block around this one, if any."""
        self.paths.remove(df._written)
        outer = Scratch.blocks()[: Scratch.blocks().index(self)]
        if outer:
            outer[-1].paths.append(df._written)
        return df

    def drop_all_but(self, df: DataFrame) -> None:
        """Delete now what the block has so far, but for one table."""
        for path in self.paths:
            if path != df._written:
                fs, at = file_system(self.spark, path)
                fs.delete(at, True)
        self.paths = [p for p in self.paths if p == df._written]

    def __exit__(self, kind, *_) -> None:
        Scratch._open.set(tuple(b for b in Scratch.blocks() if b is not self))
        for path in [] if kind else self.paths:
            fs, at = file_system(self.spark, path)
            fs.delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    What is read back survives the loss of any executor.  A table that no block deletes goes when
    the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if Scratch.blocks():
        Scratch.blocks()[-1].paths.append(path)
    else:
        fs, at = file_system(spark, path)
        fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out
