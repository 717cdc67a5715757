"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint.  Distinct fingerprints are hashed into
2^(radius+1) - 1 tables, each of which keeps the bits that one structured mask selects.
Bit i has a vector m(i) of radius+1 binary digits; table v keeps bit i where <m(i), v> is
odd.  The vectors of the at most ``radius`` bits in which a pair differs don't span the
space, so some v is orthogonal to all of them, and in that table the pair collides: no pair
within the radius is missed.

A bucket of up to ``bucket_limit`` fingerprints is resolved in one task, which gives a star
(smallest member to member) for each component within it, never all pairs.  Larger buckets
are resolved exactly and linearly without comparing members: two fingerprints are within r
bits just if some point is within r/2, rounded down, of one and r/2, rounded up, of the other
(1 and 2 for 3 bits), so each emits its surrounding points and all that meet in a point with a
member within the smaller distance are linked.

Defined results: null and blank texts have fingerprint zero, linked like any other; texts of
fewer than three words are one shingle; long texts are hashed whole, in steps of bounded size; a
bit set in exactly half the shingles is 0; repeated rows and ids are rows of their own; an empty
table gives an empty result; further columns, of any name, are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import minhash
from cohortry.llm.common import attach, columns_of, free_name, keyed, materialize
from cohortry.llm.graph import connected_components

BITS, RADIUS, WIDTH, SEED = 64, 3, 3, 42
#: Largest bucket that one task compares; about 1 MB of fingerprints.
BUCKET_LIMIT = 65_536


def fingerprint(text: bytes | None, width: int = WIDTH, step: int = 65_536) -> int:
    """64-bit SimHash of the word shingles of a text in UTF-8; whole text, in bounded steps."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: A-Z only; splits at \x20 and \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, step):
        part = words[at : at + step + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, doc_id, fp) of each row of ``docs``, which carries ``_row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["_row", "doc_id", "fp"])

    rows = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_row long, doc_id long, fp long")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The masks of the tables, as signed longs; two patterns within ``radius`` agree under one."""
    space = 2 ** (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, space)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _stars(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, other node) of each component of one bucket."""
    if len(fps) == 2:
        if np.bitwise_count(fps[0] ^ fps[1]) > radius:
            return nodes[:0], nodes[:0]
        return nodes.min(keepdims=True), nodes.max(keepdims=True)
    order = np.argsort(nodes)
    left, left_fps = nodes[order], fps[order]
    heads, tails = [], []
    while len(left) > 1:
        root, queue, got = left[0], [left_fps[0]], []
        left, left_fps = left[1:], left_fps[1:]
        while queue and len(left):
            near = np.bitwise_count(left_fps ^ queue.pop()) <= radius
            if near.any():
                got.append(left[near])
                queue.extend(left_fps[near])
                left, left_fps = left[~near], left_fps[~near]
        for x in got:
            heads.append(np.full(len(x), root))
            tails.append(x)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (nodes[:0], nodes[:0])


def _bucket_edges(active: DataFrame, radius: int) -> DataFrame:
    """Stars of the buckets that ``active`` (t, key, fp, node) holds, each within one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4

        def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
            t, key, fp, node = cols
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            found = [_stars(f.view(np.uint64), n, radius) for f, n in zip(np.split(fp, cuts), np.split(node, cuts), strict=True) if len(n) > 1]
            src = np.concatenate([x for x, _ in found]) if found else node[:0]
            dst = np.concatenate([x for _, x in found]) if found else node[:0]
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last bucket begins
            held = [c[last:] for c in cols]
            if last:
                yield edges([c[:last] for c in cols])
        if len(held[0]):
            yield edges(held)

    dealt = active.select("t", "key", "fp", "node").repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "src long, dst long")


def _ball_edges(hot: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links within buckets of any size by points in common; see the module."""
    free = [[b for b in range(BITS) if not m >> b & 1] for m in masks]  # members agree in the others
    signed = lambda x: x - 2**64 if x >= 2**63 else x

    def flips(bits: list[int]) -> list[tuple[int, int]]:
        return [(d, signed(sum(1 << b for b in some))) for d in range((radius + 1) // 2 + 1) for some in combinations(bits, d)]

    spark = hot.sparkSession
    table = spark.createDataFrame([(t, d, x) for t, bits in enumerate(free) for d, x in flips(bits)], "t int, d int, flip long")
    balls = hot.join(F.broadcast(table), "t").select("t", "node", "d", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = balls.groupBy("t", "point").agg(F.min("node").alias("hub"), F.min("d").alias("d0"), F.count("*").alias("n"))
    shared = hubs.filter((F.col("d0") <= radius // 2) & (F.col("n") > 1))
    return balls.join(shared, ["t", "point"]).filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()


def near_edges(reps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (src, dst) that connect all distinct fingerprints within ``radius``.

    ``reps`` has one row (fp, node) per distinct fingerprint.
    """
    masks = covering_masks(BITS, radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    buckets = reps.select("fp", "node", tables.alias("b")).select("b.t", "b.key", "fp", "node")
    sizes = buckets.groupBy("t", "key").agg(F.count("*").alias("m")).filter("m > 1")
    active = materialize(buckets.join(sizes, ["t", "key"]), "buckets")
    found = _bucket_edges(active.filter(F.col("m") <= bucket_limit), radius)
    hot = active.filter(F.col("m") > bucket_limit)
    if not hot.isEmpty():
        found = found.unionAll(_ball_edges(hot, masks, radius))
    return found


def near_classes(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(_row, doc_id, fp, component_row, component_id) of each row of ``docs`` (with ``_row``)."""
    rows = materialize(fingerprints(docs), "fingerprints")
    reps = materialize(rows.groupBy("fp").agg(F.min("_row").alias("node"), F.min_by("doc_id", "_row").alias("id")), "representatives")
    parts = connected_components(near_edges(reps.select("fp", "node"), bucket_limit=bucket_limit))
    root = F.coalesce("component", "node")
    rooted = reps.join(parts, "node", "left").select("fp", root.alias("component_row"))
    named = rooted.join(reps.select(F.col("node").alias("component_row"), F.col("id").alias("component_id")), "component_row")
    return attach(rows, named, ["fp"], "_row")


def deduplicate(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """``docs`` with the first document of each class of near-duplicates; same columns.

    With ``similarity`` the first documents are compared by their five-word shingles too, and
    those similar to an earlier one go as well; see ``minhash``.
    """
    row = free_name(docs, "_row")
    rows = keyed(docs, row=row)
    found = near_classes(rows.select(F.col(row).alias("_row"), "doc_id", "text"))
    stay = found.filter("_row = component_row").select(F.col("_row").alias(row))
    if similarity is not None:
        stay = materialize(stay, "first-documents")
        texts = rows.join(stay, row, "left_semi").select(F.col(row).alias("node"), "text")
        stay = stay.join(minhash.copies(texts, similarity).withColumnRenamed("node", row), row, "left_anti")
    return rows.join(stay, row, "left_semi").select(*columns_of(docs))


def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(keyed(docs)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
