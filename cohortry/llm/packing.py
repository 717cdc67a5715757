"""Best-fit packing of token sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt at random into
partitions of bounded size, and each is packed by best-fit decreasing.  Dual-feasible
functions give a lower bound of the bins that any packing needs, for each partition and for
all pieces together.  A partition whose bins meet its bound (before rounding up) is certified
and done.  While the bins in use exceed the overall bound, partitions with a gap give their
least-filled bins back, a group of partitions at a time exchanges what these held, and
best-fit decreasing packs it anew; a group keeps the new bins only if they are fewer.  After
the groups have met in one, all bins that aren't full are dealt out anew at random, two groups
at least, and packed again, until the bound is met or a round saves no bin, or under a quarter
of those over the bound.  The certificate, bins used and bins needed at least, comes with the
result.

Defined results: a null text is empty and has the end id alone; long texts are encoded whole;
repeated rows and ids are documents of their own; equal lengths are placed in order of row and
piece; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import materialize
from cohortry.llm.tokens import BYTE_BPE, encoder, tokenizer_path

CAPACITY = 2048
#: Pieces that one task packs, partitions that exchange with each other, bins that each gives.
PIECES_PER_PART, FAN_IN, BINS_GIVEN = 32_768, 16, 64


def token_pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(_row, doc_id, piece, start, length, ids) of each piece; ids are little-endian u32.

    ``docs`` carries ``_row``, a long that is unique.  Longer documents are cut so that only the first piece is short.
    """
    path = path or tokenizer_path(BYTE_BPE)
    names = ["_row", "doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), struct.pack("<I", end_id)
        for b in batches:
            out = []
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(row, doc, k, a, z - a, ids[4 * a : 4 * z]) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            cols = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    rows = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "_row long, doc_id long, piece int, start long, length long, ids binary")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length, taken in decreasing order, each into the fullest bin that holds it.

    Open bins are kept by their free space; a bit set of the spaces in use finds the least
    that is enough at once.
    """
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, opened = 0, 0
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        enough = spaces >> n
        if enough:
            space = n + (enough & -enough).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                spaces &= ~(1 << space)
        else:
            space, b, opened = capacity, opened, opened + 1
        bins[k] = b
        free[space - n].append(b)
        spaces |= 1 << (space - n)
    return bins


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Fraction:
    """A bound of the bins for ``counts`` pieces of each of ``lengths``, by dual-feasible functions.

    Any packing has at least so many bins, rounded up.

    The families: the volume; for each k, lengths rounded down to multiples of 1/k after
    scaling by k+1 (kept where the scaled length is whole); for each threshold, lengths under
    it dropped and lengths over the rest raised to a whole bin.  All in whole numbers.
    """
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = Fraction(int((x * n).sum()), capacity)
    for k in range(1, 101):
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, Fraction(int((f * n).sum()), k * capacity))
    for low in np.unique(x[x <= capacity // 2]):
        f = np.where(x > capacity - low, capacity, np.where(x >= low, x, 0))
        best = max(best, Fraction(int((f * n).sum()), capacity))
    return best


PLACED = "_row long, piece int, length long, part long, level int, bin long, place long, given boolean, bound double"


def _pack(capacity: int, level: int, given_bins: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_row", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        if "was" in rows:  # given back by other packings: kept unless the new one has fewer bins
            was = rows["was"].to_numpy()
            old, numbers = np.unique(was, return_inverse=True)
            if len(old) <= bins.max() + 1:
                bins = numbers
        fill = np.bincount(bins, lengths).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        heads = np.r_[True, np.diff(bins[order]) != 0]
        place = np.empty(len(rows), np.int64)
        place[order] = before - np.repeat(before[heads], np.diff(np.r_[np.flatnonzero(heads), len(rows)]))
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        emptiest = np.argsort(fill, kind="stable")[: given_bins if len(fill) > bound else 0]
        given = np.isin(bins, emptiest[fill[emptiest] < capacity])
        out = rows[["_row", "piece", "length"]].assign(part=int(key[0]), level=level, bin=bins, place=place, given=given, bound=float(bound))
        return out[["_row", "piece", "length", "part", "level", "bin", "place", "given", "bound"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART, fan_in: int = FAN_IN, given_bins: int = BINS_GIVEN) -> tuple[DataFrame, dict]:
    """Place each piece: (_row, piece, length, sequence_id, offset), and the certificate.

    The certificate holds the bins in use after each round and the bound over all pieces.  The
    only thing that reaches the driver is the number of pieces of each length.
    """
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most ``capacity`` rows
    total = int(sizes["n"].sum())
    bound = math.ceil(lower_bound(sizes["length"].to_numpy(), sizes["n"].to_numpy(), capacity))
    parts = max(1, -(-total // per_part))
    open_rows = pieces.select("_row", "piece", "length", F.pmod(F.xxhash64("_row", "piece"), F.lit(parts)).cast("long").alias("part"))
    level, closed, in_use = 0, [], []
    while True:
        placed = materialize(open_rows.groupBy("part").applyInPandas(_pack(capacity, level, given_bins), PLACED), f"packed-{level}")
        result = reduce(DataFrame.unionAll, [*closed, placed])
        in_use.append(result.filter("place = 0").count())  # each bin has one piece there
        if in_use[-1] <= bound or (parts == 0 and in_use[-2] - in_use[-1] < max(1, (in_use[-2] - bound) // 4)):
            break
        # What is given is packed anew by groups of partitions; the name of its bin goes along.
        was = F.xxhash64("level", "part", "bin")
        if parts > 1:
            closed.append(placed.filter("NOT given"))
            open_rows = placed.filter("given").select("_row", "piece", "length", F.expr(f"part div {fan_in}").alias("part"), was.alias("was"))
            parts = -(-parts // fan_in)
        else:
            parts = 0  # all groups have met: bins with room anywhere change partners at random
            room = result.groupBy("level", "part", "bin").agg(F.sum("length").alias("fill")).withColumn("room", F.col("fill") < capacity).drop("fill")
            filled = materialize(result.join(room, ["level", "part", "bin"]), f"filled-{level}")
            groups = max(2, -(-total // per_part))
            closed = [filled.filter("NOT room").select(*placed.columns)]
            open_rows = filled.filter("room").select("_row", "piece", "length", F.pmod(F.xxhash64(was, F.lit(level)), F.lit(groups)).alias("part"), was.alias("was"))
        level += 1
    sequence = F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft(F.col("part"), 24) + F.col("bin")
    return result.select("_row", "piece", "length", sequence.alias("sequence_id"), F.col("place").alias("offset")), {"bound": bound, "bins": in_use}


def assemble(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the ids of each sequence as one binary of little-endian u32."""
    rows = pieces.select("_row", "piece", "ids").join(placed, ["_row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` short pieces
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, dict]:
    """(pieces, places, certificate) of ``docs``: see ``token_pieces`` and ``pack``; ``assemble`` joins their ids."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())  # fixed once the pieces are written
    pieces = materialize(token_pieces(rows, capacity=capacity), "pieces")
    return pieces, *pack(pieces, capacity)


def digest(pieces: DataFrame, placed: DataFrame, certificate: dict) -> DataFrame:
    """What the query returns; ids become checksums before the join, so they aren't shuffled.

    ``sequences`` and ``least_sequences`` are those used in all and those needed at least.
    """
    named = pieces.select("_row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    met = named.join(placed.drop("length"), ["_row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return met.withColumns({"sequences": F.lit(certificate["bins"][-1]).cast("long"), "least_sequences": F.lit(certificate["bound"]).cast("long")})


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(*pack_documents(docs))
