"""WARC archives in seekable zstandard bundles.

Each page becomes one WARC/1.1 record: a response with its payload, or, where another page
has the same payload, a revisit that names that page's record and carries the HTTP header alone
(profile identical-payload-digest).  Records are grouped into independent frames of about
``FRAME_BYTES``; a file ends with a footer seek table (see ``seekable``), and an index maps
each record identifier to file, frame and offset and length within the frame, so a reader
decompresses one frame a record.

Payloads are compared by length and SHA-256, so a forged SHA-1 can't make two pages one; the digest
in the record is the SHA-1 that archives use.  Of equal payloads the record with the largest
``page_id`` is the response.  Which it is comes from a map-side combined aggregate, joined back
by salts, so that copies of one page, however many, are dealt over all tasks.

Defined results: a null or empty html is an empty payload, and those are equal like any others
(unless ``min_bytes`` is over 0); pages without an id are responses only where all equal ones
have none; of rows that repeat the largest id one is the response and the others revisit it; a
null url is written as ``unknown:``, and what can't stand in a header is percent-encoded; long
pages are frames of their own, never cut; an empty table makes no file and an empty index;
further columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from string import punctuation
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import attach, keyed, materialize, new_path, salt
from cohortry.llm.seekable import SeekableReader, SeekableWriter

#: Bytes of records after which a frame is closed, and of frames after which a file is.
FRAME_BYTES, FILE_BYTES = 1 << 20, 256 << 20
#: The table has no times of capture, and records must have one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, file string, frame int, offset long, length long"
RECORD = "record_id string, page_id long, record_type string, refers_to_record string, refers_to long, payload_digest string, payload_bytes long, url string"
_ID = re.compile(rb"<urn:page:(-?[0-9]*):([0-9]+)>")


def record_id(page_id: int | None, row: int) -> str:
    """The identifier of a page's record; ``row`` tells pages of one id apart."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_of(identifier: bytes | None) -> int | None:
    found = identifier and _ID.fullmatch(identifier)
    return int(found[1]) if found and found[1] else None


def build_record(identifier: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record with its two closing line ends; with ``refers_to`` a revisit, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {'unknown:' if url is None else quote(url, safe=punctuation)}", f"WARC-Payload-Digest: sha1:{b32encode(sha1(payload).digest()).decode()}"]
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[bytes, bytes], bytes, int]:
    """(fields by lower-case name, block, where the next record begins) of the record at an offset; a damaged one is an error."""
    end = data.find(b"\r\n\r\n", at)
    first, *lines = data[at:end].split(b"\r\n") if end >= 0 else [b""]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    start = end + 4
    stop = start + int(fields.get(b"content-length", b"-1"))
    if not first.startswith(b"WARC/1.") or stop < start or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"no whole record at {at}")
    return fields, data[start:stop], stop + 4


class BundleWriter:
    """Writes the records of one part as one or several files."""

    def __init__(self, folder: str, part: int, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES):
        self.folder, self.part, self.frame_bytes, self.file_bytes = folder, part, frame_bytes, file_bytes
        self.files, self.out, self.chunks, self.held = 0, None, [], 0

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        """Where the record will be: file, frame, and offset and length within the frame."""
        if self.out is None:
            self.out = SeekableWriter(self.folder, f"pages-{self.part:06d}-{self.files:04d}.warc.zst")
        place = (self.out.uri, len(self.out.table), self.held, len(record))
        self.chunks.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._end_frame()
            if self.out.written >= self.file_bytes:
                self.close()
        return place

    def _end_frame(self):
        self.out.add(b"".join(self.chunks))
        self.chunks, self.held = [], 0

    def close(self):
        if self.out is None:
            return
        if self.chunks:
            self._end_frame()
        self.out.close()
        self.out, self.files = None, self.files + 1


def choose_responses(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(_row, target): the pages of ``rows`` (_row, page_id, html) that are revisits, and the (page_id, _row) that they refer to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = rows.select("_row", "page_id", F.length(payload).alias("_size"), F.unhex(F.sha2(payload, 256)).alias("_digest"))
    digests = materialize(digests.filter(F.col("_size") >= min_bytes), "payload-digests")  # pages are hashed once
    # A null id is less than any other.  Copies meet as one row a task and digest.
    last = digests.groupBy("_size", "_digest").agg(F.max(F.struct("page_id", "_row")).alias("target"), F.count("*").alias("_n"))
    shared = last.filter("_n > 1").drop("_n")
    return attach(digests, shared, ["_size", "_digest"], "_row").filter("_row <> target._row").select("_row", "target")


def write_bundles(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = DATE, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page; the index of what was written: record_id, page_id, file, frame, offset, length.

    Payloads of fewer than ``min_bytes`` bytes are always responses.
    """
    from pyspark import TaskContext

    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = keyed(rows, "page_id")
    chosen = rows.join(choose_responses(rows, min_bytes), "_row", "left").select("_row", "page_id", "url", "html", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, TaskContext.get().partitionId(), frame_bytes, file_bytes)
        for b in batches:
            out = []
            row_ids, page_ids, urls, targets = (b.column(k).to_pylist() for k in (0, 1, 2, 4))
            for row, page, url, html, target in zip(row_ids, page_ids, urls, b.column(3).cast(pa.binary()), targets, strict=True):
                own = record_id(page, row)
                other = record_id(target["page_id"], target["_row"]) if target else None
                out.append((own, page, *writer.add(build_record(own, url, html.as_py() or b"", other, date))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        writer.close()

    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    # In a fixed order, so that a task that runs again writes the same file.
    return materialize(chosen.sortWithinPartitions("_row").mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, payload: bool = False) -> DataFrame:
    """What the archives hold for the records that ``index`` lists, all or any selection: RECORD, and on request the payload.

    Each frame with a listed record is read and decompressed once.  A response's digest and size are
    counted from its payload, and an error if its header says otherwise; a revisit's are from its headers.
    """
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string())])
    if payload:
        schema = schema.append(pa.field("payload", pa.binary()))

    def read(content: bytes, offset: int) -> tuple:
        fields, block, _ = parse_record(content, offset)
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)[1])
        digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:")
        kind = fields[b"warc-type"].decode()
        if kind == "response" and (size != len(body) or digest != b32encode(sha1(body).digest())):
            raise ValueError(f"damaged payload at {offset}")
        own, other = fields[b"warc-record-id"], fields.get(b"warc-refers-to")
        found = (own.decode(), page_of(own), kind, other and other.decode(), page_of(other), digest.decode(), size, fields[b"warc-target-uri"].decode())
        return (*found, body) if payload else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for b in batches:
            for file, frame, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = SeekableReader(file), file
                content = reader.content(frame)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, read(content, at), strict=True)) for at in sorted(offsets)], schema=schema)
        if reader:
            reader.close()

    frames = index.groupBy("file", "frame").agg(F.collect_list("offset").alias("offsets"))  # bounded by a frame's size
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, else few bytes of names would become one task
    dealt = frames.repartition(parts, "file", salt("frame")).sortWithinPartitions("file", "frame")
    return dealt.mapInArrow(run, RECORD + ", payload binary" * payload)


def resolve(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, payload) of the records ``wanted`` (record_id); a revisit has that of the record that it refers to.

    Two reads of single frames: of the records themselves, then of those that revisits name.
    """
    own = materialize(read_bundles(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi"), payload=True), "warc-own")
    revisits = own.filter("record_type = 'revisit'").select("record_id", "refers_to_record")
    names = revisits.select(F.col("refers_to_record").alias("record_id")).distinct()
    named = read_bundles(index.join(names, "record_id", "left_semi"), payload=True).select(F.col("record_id").alias("refers_to_record"), "payload")
    met = attach(revisits, materialize(named, "warc-named"), ["refers_to_record"], "record_id")
    return own.filter("record_type = 'response'").select("record_id", "payload").unionByName(met.select("record_id", "payload"))


def op13_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold for each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_bundles(write_bundles(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Twenty bits at a time, five hexadecimal digits become four of base 32.
OP13_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 5 * (k // 4)::INT + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""
