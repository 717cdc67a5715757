"""Centroid clustering of integer vectors by bisector tournaments.

Vectors are turned into integers, and every step is exact.  For centroids i < j the bisecting
plane has the integer normal 2(c_j - c_i) and the threshold |c_j|^2 - |c_i|^2: a vector is nearer
to j just if its product with the normal is over the threshold.  A vector plays k - 1 such
linear tests, each against the winner so far, who has the smaller number and stays at zero; the
last winner is the nearest centroid, and only its distance is computed, exactly.

A round is one pass over the vectors, which are never shuffled: a task keeps k sums of whole
numbers, so what meets is k rows a dimension and task, however vectors are distributed; the
driver gets k x dimensions sums.  Integers beyond 2^24 go through the same steps as Python's,
which have no bound; sums travel in limbs of 40 bits.

Defined results: vectors of another size, null ones, and those with a null or non-finite
component are left out; repeated rows and ids are vectors of their own; a null id is hashed as
empty text; of equal hashes the smaller vector comes first; with fewer than k vectors each is a
centroid; a centroid without vectors stays where it is; distances and inertias over 2^63 - 1 are
given as that; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import materialize

SIZE, K, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Components up to this keep all products and sums of a vector within 64 bits.
SAFE = 1 << 24
MOST = 2**63 - 1
#: Vectors that are compared at a time.
STEP = 4096
LIMB = 40


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, as 64-bit integers or, where one is beyond SAFE, as Python's."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(y) or np.abs(y).max() <= SAFE:
        return y.astype(np.int64)
    whole = lambda v, w: int(w) if math.isfinite(w) else int(v) * scale  # noqa: E731  what overflows is a whole number
    return np.array([[whole(v, w) for v, w in zip(a, b, strict=True)] for a, b in zip(x.tolist(), y.tolist(), strict=True)], dtype=object)


@dataclass(frozen=True)
class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Bisectors:
        small = all(abs(v) <= SAFE for c in centroids for v in c)
        c = np.array(centroids, np.int64 if small else object)
        lengths = (c * c).sum(axis=1)
        return cls(c, 2 * (c[None] - c[:, None]), lengths[None] - lengths[:, None])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each integer vector; ties go to the smaller number."""
        kind = np.int64 if x.dtype == self.centroids.dtype == np.int64 else object
        best = np.zeros(len(x), np.int32)
        distance = np.empty(len(x), kind)
        for at in range(0, len(x), STEP):
            v, own = x[at : at + STEP].astype(kind), best[at : at + STEP]
            for j in range(1, len(self.centroids)):
                sign = (v * self.normals[own, j]).sum(axis=1) > self.thresholds[own, j]
                own[sign.astype(bool)] = j
            distance[at : at + STEP] = ((v - self.centroids[own]) ** 2).sum(axis=1)
        return best, distance


def vectors(df: DataFrame, vec: str, id_: str, size: int) -> DataFrame:
    """(vec_id, x) of the rows whose vector has ``size`` components, all finite; written once."""
    x = F.col(vec).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = df.filter((F.size(x) == size) & ~bad).select(F.col(id_).alias("vec_id"), F.col(vec).alias("x"))
    return materialize(kept, "vectors")


def _arrays(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        x = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
        yield b.column(0), quantised(x, scale)


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id, in that order; taken in each task first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), F.col("x").cast("array<double>").alias("x")).orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in quantised(np.array([r.x]), scale)[0]] for r in rows]


def _means(kept: DataFrame, now: list[list[int]], size: int, scale: int) -> list[list[int]]:
    """The exact floor of each cluster's mean; an empty cluster keeps its centroid."""
    planes = Bisectors.of(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(now), np.int64), [[0] * size for _ in now]
        for _, x in _arrays(batches, size, scale):
            best, _ = planes.assign(x)
            counts += np.bincount(best, minlength=len(now))
            for c in np.unique(best):
                sums[c] = [a + int(b) for a, b in zip(sums[c], x[best == c].sum(axis=0), strict=True)]
        cells = [(c, -1, 0, int(counts[c])) for c in range(len(now)) if counts[c]]
        for c, d, v in ((c, d, v) for c in range(len(now)) if counts[c] for d, v in enumerate(sums[c])):
            limb, rest = 0, abs(v)
            while rest or not limb:
                cells.append((c, d, limb, (rest & ((1 << LIMB) - 1)) * (-1 if v < 0 else 1)))
                rest, limb = rest >> LIMB, limb + 1
        columns = zip(*cells, strict=True) if cells else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "d", "limb", "v"])

    parts = kept.mapInArrow(run, "c int, d int, limb int, v long")
    totals: dict[tuple[int, int], int] = {}
    for c, d, limb, v in parts.groupBy("c", "d", "limb").agg(F.sum("v").alias("v")).collect():  # k x (size + 1) x limbs
        totals[c, d] = totals.get((c, d), 0) + (v << LIMB * limb)
    return [[totals[c, d] // totals[c, -1] for d in range(size)] if (c, -1) in totals else old for c, old in enumerate(now)]


def cluster(df: DataFrame, vec: str = "embedding", id_: str = "vec_id", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), centroids) after ``rounds`` rounds and one more assignment."""
    kept = vectors(df, vec, id_, size)
    now = first_centroids(kept, k, seed, scale)
    if not now:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        now = _means(kept, now, size, scale)
    planes = Bisectors.of(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _arrays(batches, size, scale):
            best, distance = planes.assign(x)
            held = np.minimum(distance, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best), pa.array(held)], names=["vec_id", "cluster", "distance"])

    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    return materialize(kept.mapInArrow(run, schema), "clusters"), now


def op11_bisector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector, with the inertias and a digest of its centroid."""
    found, now = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    sums = {c: int(s) for c, s in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a cluster
    rows = [(c, min(sums.get(c, 0), MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(now)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """The same by comparing all distances; for engines with lists."""
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT v.n, v.vec_id, v.e, min({{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS w
  FROM v, c{r} c GROUP BY ALL)"""  # noqa: E731
    move = lambda r: f"""s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT w.c AS c, unnest(e) AS x, unnest(range(1, {SIZE + 1})) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT c, list((s - (s % m + m) % m) // m ORDER BY i) AS e FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (c))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, e) - 1)::INT AS c, e
  FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, e FROM v ORDER BY h, e LIMIT {K})),
{steps},
{near(ROUNDS)}
SELECT vec_id, w.c AS cluster, w.d AS distance, sum(w.d) OVER (PARTITION BY w.c)::BIGINT AS cluster_inertia, sum(w.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.e, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON a{ROUNDS}.w.c = c{ROUNDS}.c
"""


OP11_SQL = _rounds_sql()
