"""Token ids in seekable files: independent zstandard frames with a trailing seek table.

The files' format is that of ``seekable``.  A frame's content: number of documents (u32), bytes
of an id (u32), part of the corpus (u64), tokens of that part before the frame (u64); doc ids (i64
each, the least i64 for null); token counts (u32 each); token ids, two or four bytes each, all
little-endian.

Files go to the shared folder through its file system, under a name that only the part
determines, and appear by renaming, so a task that runs again leaves the same file.

Defined results: a null text is empty and has the end id alone; long texts are encoded whole and
never split over frames; rows of null ``doc_id`` come first; rows of one id, however many, are in
order of a hash of their texts and fill several files; repeated rows are documents of their own;
an empty table makes no file; further columns, of any name, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import materialize, new_path
from cohortry.llm.seekable import SeekableReader, SeekableWriter
from cohortry.llm.tokens import WORD_BPE, encoder, tokenizer_path

HEAD = struct.Struct("<IIQQ")
NO_ID = -(2**63)
#: Bytes of ids after which a frame, or a file, is closed; a document is never split.
FRAME_BYTES, FILE_BYTES = 256 << 10, 64 << 20
#: Documents that a part (one task's share) holds on average.
DOCS_PER_PART = 8_000


class FrameWriter:
    """Writes one part of the corpus as one or several files."""

    def __init__(self, folder: str, part: int, width: str):
        self.folder, self.part, self.width = folder, part, width
        self.files, self.tokens, self.out = 0, 0, None
        self._new_frame()

    def _new_frame(self):
        self.ids, self.counts, self.chunks, self.held, self.before = [], [], [], 0, self.tokens

    def add(self, doc_id: int | None, ids: np.ndarray) -> tuple[str, int, int]:
        """Where the document will be: file, frame and number within the frame."""
        if self.out is None:
            self.out = SeekableWriter(self.folder, f"tokens-{self.part:06d}-{self.files:04d}.zst")
        place = (self.out.uri, len(self.out.table), len(self.ids))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.chunks.append(ids.astype(self.width).tobytes())
        self.held += len(self.chunks[-1])
        self.tokens += len(ids)
        if self.held >= FRAME_BYTES:
            self._end_frame()
            if self.out.written >= FILE_BYTES:
                self.close()
        return place

    def _end_frame(self):
        n = len(self.ids)
        self.out.add(HEAD.pack(n, int(self.width[2]), self.part, self.before) + struct.pack(f"<{n}q{n}I", *self.ids, *self.counts) + b"".join(self.chunks))
        self._new_frame()

    def close(self):
        """End the file, if one is open."""
        if self.out is None:
            return
        if self.ids:
            self._end_frame()
        self.out.close()
        self.out, self.files = None, self.files + 1


class FrameReader(SeekableReader):
    """Random access to the frames of one file."""

    def frame(self, k: int) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
        """(part, tokens before, doc ids, token counts, ids) of one frame, checked."""
        content = self.content(k)
        n, width, part, before = HEAD.unpack_from(content)
        at = HEAD.size
        docs = np.frombuffer(content, "<i8", n, at)
        counts = np.frombuffer(content, "<u4", n, at + 8 * n)
        return part, before, [None if d == NO_ID else int(d) for d in docs], counts, np.frombuffer(content, f"<u{width}", -1, at + 12 * n)


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents in ascending ``doc_id`` order; the index of what was written.

    One row per document: doc_id, part, file, frame, slot.  ``end_id`` ends each document.
    Rows are dealt by ranges of ``doc_id`` and hash, so a task holds one range and streams through it.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    folder, path = folder or new_path(spark, "tokens"), path or tokenizer_path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        writer = FrameWriter(folder, part, enc.width)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [writer.add(d, np.frombuffer(enc.encode(t.as_py()) + end, "<u4")) for d, t in zip(ids, b.column(1), strict=True)]
            files, frames, slots = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(files, pa.string()), pa.array(frames, pa.int32()), pa.array(slots, pa.int32())],
                names=["doc_id", "part", "file", "frame", "slot"],
            )
        writer.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // DOCS_PER_PART)
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, "doc_id long, part long, file string, frame int, slot int"), "token-index")


def read_token_files(index: DataFrame, ids: bool = True) -> DataFrame:
    """Read back the documents that ``index`` lists: all, or any selection of its rows.

    Each frame with a listed document is read and decompressed once.  Returns doc_id, part,
    before (tokens of the part before the document), n_tokens, ids_crc32 (of the ids as
    unsigned 32-bit integers) and, on request, ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for b in batches:
            out = []
            for file, frame, slots in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = FrameReader(file), file
                part, before, docs, counts, tokens = reader.frame(frame)
                starts = np.cumsum(counts, dtype=np.int64) - counts
                for k in sorted(slots):
                    own = tokens[starts[k] : starts[k] + counts[k]].astype("<u4")
                    out.append((docs[k], part, before + int(starts[k]), len(own), zlib.crc32(own.tobytes()), own.astype(np.int64) if ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.list_(pa.int64()))] * ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "before", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    frames = index.groupBy("file", "frame").agg(F.collect_list("slot").alias("slots"))  # a frame's documents are bounded by its size
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, else few bytes of names would become one task
    dealt = frames.repartition(parts, "file").sortWithinPartitions("file", "frame")
    return dealt.mapInArrow(run, "doc_id long, part long, before long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def with_starts(read: DataFrame) -> DataFrame:
    """Add ``start``: the tokens of all documents before each, over all parts."""
    parts = read.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))  # one row per part
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("_tokens").over(w), F.lit(0)).alias("_base"))
    return read.join(base, "part").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def op3_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files hold for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = materialize(read_token_files(write_token_files(docs), ids=False), "tokens-read")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
