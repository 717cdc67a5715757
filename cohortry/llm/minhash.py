"""Near copies by the Jaccard similarity of word shingles.

Each text is the set of its five-word shingles.  432 minima of hashed shingles make 54 bands of
eight; a pair of similarity s shares a band with probability 1 - (1 - s^8)^54, which is 0.99995
at 0.8.  Bands are that deep because of passages that many texts share: where a passage is half
of each text, one text in 256 has a band within it, so few of them meet.  Pairs that share a
band and have sets of sizes that allow the similarity are only candidates: what links them is the
exact similarity of their sets.

Candidates are compared in rounds.  Each bucket's smallest rows, one and then four times as many
in each round, are compared with all later ones; a row that is similar to an earlier one goes, and leaves all
its buckets.  So a bucket of many copies costs one comparison a row and hub, not one a pair,
and at the end no two rows that stay and share a bucket are similar.

Defined results: words as for fingerprints (lower case of A-Z, split at white space); texts of
fewer than five words are one shingle; null and blank texts have none and are similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import materialize, salt

WIDTH, BANDS, DEPTH, SEED = 5, 54, 8, 42
SIMILARITY = 0.8
#: Rows of a bucket that the first round compares with the others.
HUBS = 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


#: Odd multipliers of the words of a shingle, by place.
_PLACES = np.random.default_rng(SEED + 1).integers(0, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shingle's is a sum over its words' hashes, each by its place, mixed."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = _mix(np.fromiter(map(xxh64_intdigest, words), np.uint64, n))
    width = min(WIDTH, n)
    sums = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        sums += hashes[k : n - width + 1 + k] * _PLACES[k]
    found = np.sort(_mix(sums * np.uint64(0x9E3779B97F4A7C15)))
    return found[np.r_[True, found[1:] != found[:-1]]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes; of empty ones 0."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


_SALTS = np.random.default_rng(SEED).integers(0, 2**32, (BANDS * DEPTH, 2), np.uint32)


def bands(hashes: np.ndarray, step: int = 512) -> np.ndarray:
    """One number for each band of a set that isn't empty."""
    low = np.full(BANDS * DEPTH, 2**32 - 1, np.uint32)
    factor, shift = _SALTS[:, :1] | np.uint32(1), _SALTS[:, 1:]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), step):
        low = np.minimum(low, (short[None, at : at + step] * factor + shift).min(axis=1))
    out = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, DEPTH).T.astype(np.uint64):
        out = _mix((out ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


def band_keys(texts: DataFrame) -> DataFrame:
    """(node, n, keys), with the size of its set, of each row of ``texts`` (node, text) that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, keys = [], [], []
            for node, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                s = shingle_set(t.as_py())
                if len(s):
                    nodes.append(node)
                    sizes.append(len(s))
                    keys.append(bands(s).view(np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["node", "n", "keys"])

    return texts.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, n long, keys array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``node`` of each pair (hub, node) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for b in batches:
            found = []
            for h, x, node, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), b.column(3).cast(pa.binary()), strict=True):
                if h != hub:  # rows come sorted by hub
                    hub, own = h, shingle_set(x.as_py())
                if jaccard(own, shingle_set(y.as_py())) >= least:
                    found.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])

    text = F.col("text").cast("string")
    hubs = texts.select(F.col("node").alias("hub"), text.alias("hub_text"))
    met = pairs.join(texts.select("node", text.alias("node_text")), "node").join(hubs, "hub")
    return met.select("hub", "hub_text", "node", "node_text").sortWithinPartitions("hub").mapInArrow(run, "node long").distinct()


def _first(active: DataFrame, n: int) -> DataFrame:
    """(t, key, hub, hub_n): the ``n`` smallest rows of each bucket; those of each part of a bucket come first, so that no task sorts a hot one."""
    if n == 1:
        return active.groupBy("t", "key").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"))
    salted = active.withColumn("s", salt("node"))
    for by in (["t", "key", "s"], ["t", "key"]):
        salted = salted.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("node"))).filter(F.col("k") <= n)
    return salted.select("t", "key", F.col("node").alias("hub"), F.col("n").alias("hub_n"))


def copies(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node): the rows of ``texts`` (node, text) that go, each similar to an earlier one."""
    spark = texts.sparkSession
    keys = materialize(band_keys(texts), "bands")
    buckets = keys.select("node", "n", F.posexplode("keys").alias("t", "key"))
    hot = buckets.groupBy("t", "key").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    active = materialize(buckets.join(hot, ["t", "key"]), "band-buckets")
    held = materialize(texts.select("node", "text").join(active.select("node").distinct(), "node", "left_semi"), "band-texts")
    gone, hubs = spark.createDataFrame([], "node long"), HUBS
    while not active.isEmpty():
        heads = materialize(_first(active, hubs), "hubs")
        fits = F.least("n", "hub_n") >= (least - 1e-9) * F.greatest("n", "hub_n")
        pairs = active.join(heads, ["t", "key"]).filter((F.col("hub") < F.col("node")) & fits).select("hub", "node").distinct()
        new = materialize(_similar(pairs, held, least), "copies")
        gone = gone.unionAll(new)
        # Pairs of this round's hubs are settled, and a row that goes needs no more comparison.
        left = active.join(heads.select("t", "key", F.col("hub").alias("node")), ["t", "key", "node"], "left_anti").join(new, "node", "left_anti")
        many = left.groupBy("t", "key").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
        active = materialize(left.join(many, ["t", "key"]).select("node", "n", "t", "key"), "band-buckets")
        hubs *= 4
    return gone.distinct()
