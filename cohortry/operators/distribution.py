"""Early fronts in each group's distribution of values, as relational steps.

A density estimate on a grid, its peaks and valleys, its derivatives and a histogram give, per
group, an early mode and a cut-off with a confidence and flags; rows are classified by them.

The estimate shares each value between its two grid points first (map-side combined, so that a
group of any size is at most a grid of weights), then sums the kernel over the weights.  That
differs from the sum over the values by at most an eighth of the squared ratio of grid step to
bandwidth, relative to the kernel's height.  ``kde_exact`` sums over the values themselves.
Quantiles are exact: values are counted, ranked over buckets of their range, and picked.

Valid values are positive and finite; others, and nulls, are kept by ``classify`` as uncertain.  Names of flags,
methods, confidences and statuses are fixed values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.functions.scalar import in_minutes
from cohortry.operators.ranks import bucket_of, cuts_of, running
from cohortry.sources.shared import materialize


@dataclass(frozen=True)
class FrontParams:
    """Limits of the detection.  Fixed values."""

    min_n: int = 30
    grid: int = 2000
    early_quantile: float = 0.35
    min_valley_depth: float = 0.25
    min_cluster_share: float = 0.01
    min_cluster: int = 5
    early_range_share: float = 0.20
    min_peak_share: float = 0.02
    max_t0_share: float = 0.15
    max_t0: float = 3.0
    max_t0_quantile: float = 0.20
    max_cutoff_share: float = 0.20
    max_cutoff_quantile: float = 0.40
    weak_k: float = 1.0
    drop_share: float = 0.30
    min_enrichment: float = 1.8
    min_global_share: float = 0.75
    late_cutoff_quantile: float = 0.70
    min_slope_share: float = 0.20
    slope_relax: float = 0.25
    shoulder_share: float = 0.60
    hist_to_second: float = 2.5
    hist_to_rest: float = 3.0
    hist_two_share: float = 0.20
    hist_two_each: float = 1.5
    hist_two_mean: float = 2.0
    hist_sparse_first: float = 0.02
    hist_second_to_rest: float = 2.5
    hist_drop: float = 0.20
    hist_first_share: float = 0.08
    hist_valley_bins: int = 4
    hist_cutoff_share: float = 0.30


P = FrontParams()


def valid(df: DataFrame, group: str, value: str, units: str = "minutes") -> DataFrame:
    """(g, x): positive, finite values, in minutes."""
    x = in_minutes(F.col(value).cast("double"), units)
    return df.select(F.col(group).alias("g"), x.alias("x")).filter("x > 0 AND x < double('infinity')")  # NaN is over infinity


def early_outlier(rows: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """(g, early_outlier): one smallest value, set apart by a gap far over the usual one.

    Gaps are those between distinct values, and zeros between equal ones, which don't count; so
    values are counted first, and a value's gap is looked up in its bucket or the next that has one.
    """
    counts = materialize(rows.groupBy("g", "x").agg(F.count("*").alias("k")), "counts")  # read for heads, gaps and sizes
    placed = counts.withColumn("b", bucket_of("x", cuts_of(counts, "x") if cuts is None else cuts))
    w = Window.partitionBy("g", "b").orderBy("x")
    heads = placed.groupBy("g", "b").agg(F.min("x").alias("head"))
    after = heads.select("g", "b", F.lead("head").over(Window.partitionBy("g").orderBy("b")).alias("beyond"))
    gaps = placed.withColumn("next", F.lead("x").over(w)).join(after, ["g", "b"]).select("g", "x", "k", (F.coalesce("next", "beyond") - F.col("x")).alias("gap"))
    met = materialize(gaps.join(counts.groupBy("g").agg(F.sum("k").alias("n"), F.min("x").alias("low")), "g"), "gaps")
    lowest = F.col("x") == F.col("low")
    # The first gap is zero where the smallest value recurs; its gap to the next then is a later one.
    first = met.filter(lowest).select("g", "n", F.when(F.col("k") > 1, F.lit(0.0)).otherwise(F.col("gap")).alias("first"))
    later = met.filter((F.col("gap") > 0) & ~(lowest & (F.col("k") == 1))).select("g", F.col("gap").alias("x"))
    usual = quantiles(later, {"usual": 0.5})
    s = first.join(usual, "g", "left")
    usual = F.when(F.coalesce("usual", F.lit(0.0)) == 0, F.lit(1e-6)).otherwise(F.col("usual"))
    return s.select("g", (F.col("n") >= 4).__and__(F.col("first") > F.greatest(F.lit(0.5), 5 * usual)).alias("early_outlier"))


def value_profile(rows: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """(g, n, low, high, top_share, many_duplicates, narrow_range, early_outlier)."""
    counts = rows.groupBy("g", "x").agg(F.count("*").alias("k"))
    s = counts.groupBy("g").agg(F.sum("k").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), (F.max("k") / F.sum("k")).alias("top_share"))
    s = s.withColumns({"many_duplicates": F.col("top_share") > 0.20, "narrow_range": (F.col("high") - F.col("low")) < 0.25})
    return s.join(early_outlier(rows, cuts), "g")


def quantiles(rows: DataFrame, shares: dict[str, float], cuts: list[float] | None = None, scales: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(g, names...): exact quantiles of each group, interpolated, at the named shares; on an ascending scale of the values where ``scales`` has the name.

    The values at the ranks around each share are found by running counts over buckets of the
    values, so no task holds a group's.  ``cuts`` between the buckets are looked up if not given.
    """
    counts = materialize(rows.groupBy("g", "x").agg(F.count("*").alias("k")), "counts")  # read for cuts, sums and ranks
    placed = running(counts, ["g"], bucket_of("x", cuts_of(counts, "x") if cuts is None else cuts), ["x"], F.col("k"))
    at = {name: F.lit(q) * (F.col("_total") - 1) for name, q in shares.items()}
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("k"))
    needed = [holds(f(p)) for p in at.values() for f in (F.floor, F.ceil)]
    picked = placed.filter(reduce(lambda a, b: a | b, needed))
    ends = [F.max(F.when(holds(f(p)), F.col("x"))).alias(f"{name}_{end}") for name, p in at.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    found = picked.groupBy("g", "_total").agg(*ends)
    between = []
    for n, p in at.items():
        low, high = (scales or {}).get(n, lambda x: x)(F.col(f"{n}_low")), (scales or {}).get(n, lambda x: x)(F.col(f"{n}_high"))
        between.append((low + (p - F.floor(p)) * (high - low)).alias(n))
    return found.select("g", *between)


#: Bandwidths, in standard deviations, by the number of values.  Fixed rules of Scott and Silverman for one dimension.
BANDWIDTHS = {"scott": lambda n: F.pow(n, F.lit(-0.2)), "silverman": lambda n: F.pow(n * 0.75, F.lit(-0.2))}
#: Bandwidths from which a kernel is zero in double precision.
REACH = 39


def _spread(rows: DataFrame, min_n: int, bandwidth: str = "scott", log: bool = True) -> tuple[DataFrame, DataFrame]:
    """(g, y), with y = ln(1 + x) if ``log``, and (g, n, low, high, h) of the groups that have an estimate; h is the bandwidth."""
    logs = rows.select("g", (F.log1p("x") if log else F.col("x").cast("double")).alias("y"))
    s = logs.groupBy("g").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.stddev_samp("y").alias("sd"))
    s = s.filter((F.col("n") >= min_n) & (F.col("high") > F.col("low")))
    return logs, s.select("g", "n", "low", "high", (BANDWIDTHS[bandwidth](F.col("n")) * F.col("sd")).alias("h"))


def _curve(k: np.ndarray, n: np.ndarray, f: np.ndarray, r: float, size: int, q: int) -> np.ndarray:
    """At each grid point, the kernel's sum over the weights; ``f`` of each ``n`` belongs to the next place.

    Places are every ``q``-th grid point, and go on beyond the grid.  Where they are the grid's own, every
    weight adds its multiple of one kernel, shifted; weights of zero cost nothing.
    """
    k = np.asarray(k, np.int64)
    if q == 1:
        m = int(min(max(size - 1 - k.min(), k.max() + 1), math.ceil(REACH / r)))  # beyond it nothing reaches the grid
        near = (k >= -m) & (k + 1 < size + m)
        w = np.zeros(size + 2 * m)
        np.add.at(w, k[near] + m, (n - f)[near])
        np.add.at(w, k[near] + m + 1, f[near])
        used = np.flatnonzero(w)
        z = np.arange(-m - size + 1, m + size) * r
        shifted = np.lib.stride_tricks.sliding_window_view(np.exp(-0.5 * z * z), size)[::-1]  # row i: the kernel of place i - m
        sums = np.zeros(size)
        for start in range(0, len(used), 128):
            some = used[start : start + 128]
            sums += w[some] @ shifted[some]
        return sums
    first = k.min()
    w = np.zeros(k.max() + 2 - first)
    np.add.at(w, k - first, n - f)
    np.add.at(w, k - first + 1, f)
    used = np.flatnonzero(w)
    sums = np.empty(size)
    for start in range(0, size, 64):
        z = (np.arange(start, min(size, start + 64))[:, None] - (used[None, :] + first) * q) * r
        sums[start : start + 64] = np.exp(-0.5 * z * z) @ w[used]
    return sums


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _kernel_sums(at: pd.Series, whole: pd.Series, part: pd.Series, ratio: pd.Series, grid: pd.Series, every: pd.Series) -> pd.Series:
    """``_curve`` of each group."""
    return pd.Series([_curve(*one) for one in zip(at, whole, part, ratio, grid, every, strict=True)])


def _cells(rows: DataFrame, grid: int = P.grid, min_n: int = P.min_n, bandwidth: str = "scott", span: tuple[float, float] | None = None, log: bool = True) -> tuple[DataFrame, Column, Column]:
    """(g, n, low, high, h, cells): each group's weights on its grid; and the grid's step, and the places' distance in steps."""
    logs, s = _spread(rows, min_n, bandwidth, log)
    if span:
        s = s.withColumns({"low": F.lit(float(span[0])), "high": F.lit(float(span[1]))})
    step = (F.col("high") - F.col("low")) / (grid - 1)
    every = F.greatest(F.lit(1), F.floor(F.col("h") / step / 2000)).cast("long") if span else F.lit(1).cast("long")
    met = logs.join(s, "g")
    if span:
        met = met.filter((F.col("y") > F.col("low") - REACH * F.col("h")) & (F.col("y") < F.col("high") + REACH * F.col("h")))
    place = (F.col("y") - F.col("low")) / step / every
    cell = (F.floor(place) if span else F.least(F.floor(place), F.lit(grid - 2))).cast("long")
    cells = met.groupBy("g", cell.alias("k")).agg(F.count("*").alias("whole"), F.sum(place - cell).alias("part"))
    arrays = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "whole", "part"))).alias("cells"))  # at most the grid and what kernels reach
    return arrays.join(s, "g"), step, every


def kde(rows: DataFrame, grid: int = P.grid, min_n: int = P.min_n, bandwidth: str = "scott", span: tuple[float, float] | None = None, log: bool = True) -> DataFrame:
    """(g, i, gx, density): Gaussian estimate of ln(1 + x), or of x, on an even grid, from weights on its points.

    The grid is over each group's range, or over ``span``, beyond which weights go on as far as kernels
    reach.  There, where a bandwidth is over 4000 steps, weights are on every so manieth point, 2000 or more a
    bandwidth.  Groups under ``min_n`` rows or of one value have none.
    """
    arrays, step, every = _cells(rows, grid, min_n, bandwidth, span, log)
    lists = [F.col(f"cells.{f}") for f in ("k", "whole", "part")]
    sums = arrays.select("g", "n", "low", "high", "h", _kernel_sums(*lists, step / F.col("h"), F.lit(grid), every).alias("sums"))
    points = sums.select("*", F.posexplode("sums").alias("i", "sum"))
    return points.select("g", "i", (F.col("low") + F.col("i") * step).alias("gx"), (F.col("sum") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def kde_exact(rows: DataFrame, grid: int, min_n: int = P.min_n) -> DataFrame:
    """As ``kde``, summed over the distinct values themselves: work for each value and grid point, dealt by both."""
    logs, s = _spread(rows, min_n)
    step = (F.col("high") - F.col("low")) / (grid - 1)
    weights = logs.groupBy("g", "y").agg(F.count("*").alias("w"))
    points = weights.join(s, "g").select("g", "y", "w", "n", "h", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    points = points.withColumn("gx", F.col("low") + F.col("i") * step)
    z = (F.col("gx") - F.col("y")) / F.col("h")
    total = F.sum(F.col("w") * F.exp(-0.5 * z * z)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))
    return points.groupBy("g", "i").agg(F.first("gx").alias("gx"), total.alias("density"))


def gradients(curve: DataFrame) -> DataFrame:
    """Add the first and second derivative: central differences, one-sided at the ends."""
    w = Window.partitionBy("g").orderBy("i")

    def slope(c: str) -> Column:
        before, after = F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))
        x0, x1 = F.coalesce(F.lag("gx").over(w), F.col("gx")), F.coalesce(F.lead("gx").over(w), F.col("gx"))
        return F.try_divide(after - before, x1 - x0)

    return curve.withColumn("gradient", slope("density")).withColumn("curvature", slope("gradient"))


def extrema(curve: DataFrame) -> DataFrame:
    """(g, i, kind, gx, density): peaks and valleys; a plateau counts once, at its middle; an end counts as a peak if higher than its neighbour."""
    w = Window.partitionBy("g").orderBy("i")
    new = F.coalesce((F.col("density") != F.lag("density").over(w)).cast("int"), F.lit(1))
    runs = curve.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy("g", "run").agg(F.min("i").alias("a"), F.max("i").alias("z"), F.first("density").alias("d"), F.min("gx").alias("x0"), F.max("gx").alias("x1"))
    r = Window.partitionBy("g").orderBy("run")
    near = flat.withColumns({"before": F.lag("d").over(r), "after": F.lead("d").over(r)})
    inner = F.col("before").isNotNull() & F.col("after").isNotNull()
    single = F.col("a") == F.col("z")
    kind = (
        F.when(inner & (F.col("d") > F.col("before")) & (F.col("d") > F.col("after")), "peak")
        .when(inner & (F.col("d") < F.col("before")) & (F.col("d") < F.col("after")), "valley")
        .when(~inner & single & (F.col("d") > F.coalesce("before", "after")), "peak")
    )
    i = F.floor((F.col("a") + F.col("z")) / 2).cast("int")
    gx = F.col("x0") + F.coalesce(F.try_divide((i - F.col("a")) * (F.col("x1") - F.col("x0")), F.col("z") - F.col("a")), F.lit(0.0))
    return near.select("g", i.alias("i"), kind.alias("kind"), gx.alias("gx"), F.col("d").alias("density")).filter("kind IS NOT NULL")


def _slope(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As ``gradients``; NaN where there is none."""
    before, after = np.append(y[:1], y[:-1]), np.append(y[1:], y[-1:])
    before, after = np.where(np.isnan(before), y, before), np.where(np.isnan(after), y, after)
    across = np.append(x[1:], x[-1:]) - np.append(x[:1], x[:-1])
    return np.divide(after - before, across, out=np.full(len(y), np.nan), where=across != 0)


def _turns(d: np.ndarray, x: np.ndarray) -> list[tuple[int, str, float, float]]:
    """(i, kind, gx, density) of a curve's extrema, as ``extrema`` has them."""
    new = np.flatnonzero(np.diff(d)) + 1
    a, z = np.append(0, new), np.append(new - 1, len(d) - 1)
    v, out = d[a], []
    if len(v) > 1:
        rises = np.diff(v) > 0
        inner = np.flatnonzero(rises[1:] != rises[:-1]) + 1
        found = [(k, "peak" if rises[k - 1] else "valley") for k in inner.tolist()]
        found = [(0, "peak")] * bool(not rises[0] and a[0] == z[0]) + found + [(len(v) - 1, "peak")] * bool(rises[-1] and a[-1] == z[-1])
        for k, kind in found:
            i = int(a[k] + z[k]) // 2
            out.append((i, kind, float(x[a[k]] + ((i - a[k]) * (x[z[k]] - x[a[k]]) / (z[k] - a[k]) if z[k] > a[k] else 0.0)), float(v[k])))
    return out


_PLACES = ("drop", "relax", "shoulder")
_SHAPE = "kind string, i int, gx double, density double, len int, top double, steepest double, reference double, steep double, " + ", ".join(f"{w}_x double, {w}_d double" for w in _PLACES)


def _shape(d: np.ndarray, x: np.ndarray, zone: float, p: FrontParams) -> list[tuple]:
    """Rows of ``_SHAPE``: one for the curve, one for each extremum; of early peaks also what the curve does after them."""
    slope = _slope(d, x)
    bend = _slope(slope, x)
    number = lambda v: None if np.isnan(v) else float(v)
    least = lambda v: np.nanmin(v) if not np.isnan(v).all() else np.nan
    top, far = d.max(), d[x > zone]
    curve = (len(d), float(top), number(-least(-np.abs(slope))), float(np.median(far)) if len(far) else None)
    out = [("curve", None, None, None, *curve, *[None] * 7)]
    down = (slope < 0) & (bend > 0)
    for i, kind, gx, density in _turns(d, x):
        steep, places = None, [None] * 6
        if kind == "peak" and i < len(d) - 1 and gx <= zone and density >= 0.10 * top:
            steep = number(abs(least(slope[i : min(len(d), i + max(4, len(d) // 20))])))
            low = d <= p.drop_share * density
            relaxed = down & (np.abs(slope) <= p.slope_relax * steep) if steep is not None else np.zeros(len(d), bool)
            first = lambda test, i=i: (np.flatnonzero(test[i + 1 :])[:1] + i + 1).tolist()
            ways = first(low & down) or first(low), first(relaxed), first(d <= p.shoulder_share * density)
            places = [v for way in ways for v in ((float(x[way[0]]), float(d[way[0]])) if way else (None, None))]
        out.append((kind, i, gx, density, *curve, steep, *places))
    return out


def shapes(rows: DataFrame, lim: DataFrame, p: FrontParams = P) -> DataFrame:
    """(g, kind, ...): a row of kind curve for each group that has an estimate, and a row for each of its extrema.

    The curve itself, ``p.grid`` points a group, never leaves the task that sums it up: what the detectors need of it are a few
    numbers an extremum.
    """
    arrays, step, _ = _cells(rows, p.grid, p.min_n)
    given = arrays.join(lim.select("g", "zone"), "g").select("g", "n", "low", "h", step.alias("step"), (step / F.col("h")).alias("ratio"), "zone", "cells")
    kind = rows.schema["g"]
    schema = T.StructType([kind, *T.StructType.fromDDL(_SHAPE).fields])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch, at, out = whole.slice(start, 500), [], []
                scalars = [batch.column(c).to_pylist() for c in ("n", "low", "h", "step", "ratio", "zone")]
                for r, (n, low, h, step, ratio, zone) in enumerate(zip(*scalars, strict=True)):
                    weights = batch.column("cells")[r].values
                    k, w, f = (weights.field(c).to_numpy(zero_copy_only=False) for c in ("k", "whole", "part"))
                    density = _curve(k, w, f, ratio, p.grid, 1) / (n * h * math.sqrt(2 * math.pi))
                    found = _shape(density, low + np.arange(p.grid) * step, zone, p)
                    at += [r] * len(found)
                    out += found
                columns = [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(at)), *columns], schema=arrow)

    return given.mapInArrow(run, schema)


def limits(rows: DataFrame, p: FrontParams = P, cuts: list[float] | None = None) -> DataFrame:
    """(g, n, zone, max_t0, valley_limit, drop_limit, hist_limit, cluster): what a group's front must meet.

    ``zone`` is on the scale of ln(1 + x).
    """
    s = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("x").alias("top"), F.min(F.log1p("x")).alias("y0"), F.max(F.log1p("x")).alias("y1"))
    cuts = cuts_of(rows, "x") if cuts is None else cuts
    s = s.join(quantiles(rows, {"qv": p.max_cutoff_quantile, "qd": p.late_cutoff_quantile, "yq": p.early_quantile}, cuts, {"yq": F.log1p}), "g")
    return s.select(
        "g",
        "n",
        F.greatest("yq", F.col("y0") + p.early_range_share * (F.col("y1") - F.col("y0"))).alias("zone"),
        F.least(F.col("top") * p.max_t0_share, F.lit(p.max_t0)).alias("max_t0"),
        F.least("qv", F.col("top") * p.max_cutoff_share).alias("valley_limit"),
        F.least("qd", F.col("top") * p.max_cutoff_share).alias("drop_limit"),
        F.least("qd", F.col("top") * p.hist_cutoff_share).alias("hist_limit"),
        F.greatest(F.lit(p.min_cluster), F.ceil(p.min_cluster_share * F.col("n"))).alias("cluster"),
    )


def _below(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` (g, cut, ...) with ``size``, the values of the group up to the cut; a few cuts a group.

    A group's cuts go to its rows as one sorted array, each row counts at the first cut that
    holds it (map-side combined), and sums over the cuts give the sizes: rows never multiply.
    """
    cuts = materialize(cuts, "cuts")  # read for the arrays and for the sizes
    listed = cuts.groupBy("g").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    first = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    counts = rows.join(listed, "g").groupBy("g", first.alias("at")).agg(F.count("*").alias("n"))
    held = counts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    places = listed.join(held, "g").select("g", "m", F.posexplode("cuts").alias("at", "cut"))
    upto = F.aggregate(F.sequence(F.lit(0), F.col("at")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return cuts.join(places.select("g", "cut", upto.alias("size")), ["g", "cut"])


def mode_valley(rows: DataFrame, shape: DataFrame, lim: DataFrame, p: FrontParams = P) -> DataFrame:
    """(g, mode, cut, depth, size): the first early peak that has an acceptable valley after it, with the first such.

    ``shape``, of ``shapes``, and ``lim`` are read several times, so write them first; so with the other detectors.
    """
    peaks = shape.filter("kind = 'peak'").join(lim, "g")
    peaks = peaks.filter((F.col("gx") <= F.col("zone")) & (F.col("density") >= p.min_peak_share * F.col("top")))
    peaks = peaks.withColumn("mode", F.expm1("gx")).filter("mode > 0 AND mode <= max_t0")
    peaks = peaks.select("g", F.col("i").alias("pi"), "mode", F.col("density").alias("pd"), "valley_limit", "cluster")
    valleys = shape.filter("kind = 'valley'").select("g", F.col("i").alias("vi"), F.expm1("gx").alias("cut"), F.col("density").alias("vd"))
    pairs = peaks.join(valleys, "g").filter("vi > pi AND cut <= valley_limit").withColumn("depth", 1 - F.col("vd") / F.col("pd"))
    ok = _below(rows, pairs.filter(F.col("depth") >= p.min_valley_depth)).filter("size >= cluster")
    first = Window.partitionBy("g").orderBy("pi", "vi")
    return ok.withColumn("k", F.row_number().over(first)).filter("k = 1").select("g", "mode", "cut", "depth", "size")


def density_drop(rows: DataFrame, shape: DataFrame, lim: DataFrame, p: FrontParams = P) -> DataFrame:
    """(g, mode, cut, depth, size, flags) for dominant early peaks without a valley; mode is null if none is accepted.

    ``shape`` tells of each early peak what the curve does after it; the first accepted peak wins,
    and flags are those of the peaks up to it, in order.
    """
    peaks = shape.filter("kind = 'peak'").join(lim, "g")
    peaks = peaks.filter((F.col("i") < F.col("len") - 1) & (F.col("gx") <= F.col("zone")) & (F.col("density") >= 0.10 * F.col("top")))
    place = lambda s: F.when(F.col(f"{s}_x").isNotNull(), F.struct(F.expm1(f"{s}_x").alias("cut"), F.col(f"{s}_d").alias("density"))).alias(s)
    found = peaks.select("g", F.col("i").alias("pi"), F.expm1("gx").alias("mode"), F.col("density").alias("pd"), "top", "steepest", "max_t0", "drop_limit", "cluster", "reference", "steep", *map(place, _PLACES))
    in_time = lambda s: F.col(f"{s}.cut") <= F.col("drop_limit")
    found = found.withColumn("late", (F.col("mode") > F.col("max_t0")))
    weak = (F.try_divide(F.col("pd"), F.col("reference")) < p.min_enrichment) & (F.col("pd") / F.col("top") < p.min_global_share)
    found = found.withColumns({"weak": ~F.col("late") & F.coalesce(weak, F.lit(False)), "blank": ~F.col("late") & F.coalesce(F.col("reference") <= 0, F.lit(True))})
    slow = F.col("steep") < p.min_slope_share * F.col("steepest")
    found = found.withColumn("slow", ~F.col("late") & ~F.col("weak") & ~F.col("blank") & F.coalesce(slow, F.lit(True)))
    found = found.withColumn("open", ~F.col("late") & ~F.col("weak") & ~F.col("blank") & ~F.col("slow"))
    way = F.when(in_time("drop"), "drop").when(in_time("relax"), "relax").when(F.col("shoulder").isNotNull(), "shoulder")
    found = found.withColumn("way", F.when(F.col("open"), way))
    place = F.when(F.col("way") == "drop", F.col("drop")).when(F.col("way") == "relax", F.col("relax")).when(F.col("way") == "shoulder", F.col("shoulder"))
    found = found.withColumn("place", place).withColumn("cut", F.col("place.cut")).withColumn("depth", 1 - F.col("place.density") / F.col("pd"))
    found = materialize(found, "peaks")
    sized = found.join(_below(rows, found.filter("cut IS NOT NULL").select("g", "cut", "pi")).select("g", "pi", "size"), ["g", "pi"], "left")
    too_late, small = F.col("cut") > F.col("drop_limit"), F.col("size") < F.col("cluster")
    accepted = F.coalesce(~too_late & ~small, F.lit(False))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(F.col("late"), "putative_t0_candidate_too_late"),
            flag(F.col("weak"), "no_dominant_early_density"),
            flag(F.col("slow"), "insufficient_initial_density_drop"),
            flag(F.col("open") & F.col("drop").isNull(), "insufficient_density_drop"),
            flag(F.col("open") & ~in_time("drop"), "fallback_density_drop_cutoff_too_late"),
            flag(F.col("way") == "relax", "cutoff_estimated_from_slope_relaxation"),
            flag(F.col("way") == "shoulder", "cutoff_estimated_from_early_shoulder"),
            flag(too_late, "fallback_cutoff_too_late"),
            flag(~too_late & small, "fallback_early_cluster_too_small"),
            flag(accepted, "cutoff_estimated_from_density_drop"),
        )
    )
    sized = sized.withColumns({"ok": accepted, "own_flags": flags})
    # The order of peaks decides which is taken and which flags were raised on the way.
    chosen = sized.groupBy("g").agg(F.min(F.when(F.col("ok"), F.struct("pi", "mode", "cut", "depth", "size"))).alias("best"), F.array_sort(F.collect_list(F.struct("pi", "own_flags"))).alias("all"))
    raised = F.filter("all", lambda x: F.col("best").isNull() | (x["pi"] <= F.col("best.pi")))
    chosen = chosen.select("g", "best.mode", "best.cut", "best.depth", "best.size", F.array_distinct(F.flatten(F.transform(raised, lambda x: x["own_flags"]))).alias("flags"))
    chosen = materialize(chosen, "chosen")  # a row a group
    none = lim.join(chosen, "g", "left_anti").join(shape.filter("kind = 'curve'"), "g", "left_semi")
    lost = none.select("g", *[F.lit(None).cast(t).alias(k) for k, t in (("mode", "double"), ("cut", "double"), ("depth", "double"), ("size", "bigint"))], F.array(F.lit("no_early_mode_detected")).alias("flags"))
    return chosen.unionByName(lost)


def histogram(rows: DataFrame) -> DataFrame:
    """(g, bins, low, high, bin, n): counts of even bins, between 10 and 60 by the root of the size; the last is closed."""
    s = rows.groupBy("g").agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")).filter("high > low")
    s = s.withColumn("bins", F.least(F.lit(60), F.greatest(F.lit(10), F.floor(F.sqrt("rows")))).cast("int"))
    at = F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins"))).cast("int")
    return rows.join(s, "g").groupBy("g", "bins", "low", "high", at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_front(rows: DataFrame, profile: DataFrame, lim: DataFrame, p: FrontParams = P, cuts: list[float] | None = None) -> DataFrame:
    """(g, mode, cut, depth, size, flags): a front from strongly filled first bins; mode is null if there is none."""
    h = histogram(rows).groupBy("g", "bins", "low", "high").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)))
    edge = lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / F.col("bins")
    h = h.withColumn("c", counts).join(lim, "g").join(profile.select("g", "early_outlier"), "g")
    mean = lambda start: F.aggregate(F.slice("c", start + 1, 60), F.lit(0.0), lambda a, x: a + x) / (F.col("bins") - start)
    h = h.withColumns({"first": F.get("c", F.lit(0)), "second": F.get("c", F.lit(1)), "rest": mean(1), "rest2": mean(2)})
    first, second, rest, rest2 = F.col("first"), F.col("second"), F.col("rest"), F.col("rest2")
    h = h.filter((F.col("n") >= 10) & (rest > 0) & ((first / F.col("n") >= p.hist_first_share) | F.col("early_outlier")))
    two_share, two_mean = (first + second) / F.col("n"), (first + second) / 2.0
    two_strong = (rest2 > 0) & (two_share >= p.hist_two_share) & (two_mean >= p.hist_two_mean * rest2)
    single = (first >= p.hist_to_second * F.greatest(second, F.lit(1))) & (first >= p.hist_to_rest * rest)
    two = two_strong & (first >= p.hist_two_each * rest2) & (second >= p.hist_two_each * rest2)
    outlier = F.col("early_outlier") & two_strong & (first / F.col("n") <= p.hist_sparse_first) & (second >= p.hist_second_to_rest * rest2)
    h = h.withColumns({"hit": single | two | outlier, "pair": ~single & (two | outlier), "from_second": ~single & outlier})

    def first_bin(test) -> Column:
        """The first of the bins after the first one that passes and ends in time."""
        stop = F.least(F.col("bins") - 1, F.lit(p.hist_valley_bins + 1)) - 1
        fits = F.filter(F.sequence(F.lit(1), stop), lambda i: test(i) & (edge(i + 1) <= F.col("hist_limit")))
        return F.get(fits, F.lit(0))

    c = lambda i: F.get("c", i)
    h = h.withColumns({
        "valley": first_bin(lambda i: (c(i) <= c(i - 1)) & (c(i) <= c(i + 1))),
        "fall": first_bin(lambda i: c(i) <= p.hist_drop * F.col("first")),
    })
    way = F.when(F.col("hit") & F.col("pair") & (edge(F.lit(2)) <= F.col("hist_limit")), "pair")
    for name, cond in (("valley", F.col("valley").isNotNull()), ("fall", F.col("fall").isNotNull()), ("edge", edge(F.lit(1)) <= F.col("hist_limit"))):
        way = way.when(F.col("hit") & ~F.col("pair") & cond, name)
    h = h.withColumn("way", way)
    bin_ = F.when(F.col("way") == "pair", 2).when(F.col("way") == "valley", F.col("valley")).when(F.col("way") == "fall", F.col("fall")).when(F.col("way") == "edge", 1)
    end = F.when(F.col("way").isin("pair", "edge"), edge(bin_)).otherwise(edge(bin_ + 1))
    reference = F.greatest(F.when(F.col("pair"), two_mean).otherwise(first.cast("double")), F.lit(1.0))
    h = h.withColumns({"cut": end, "depth": 1 - c(bin_.cast("int")) / reference})
    h = h.withColumns({"from": F.when(F.col("from_second"), edge(F.lit(1))).otherwise(F.col("low")), "to": F.when(F.col("from_second"), edge(F.lit(2))).otherwise(edge(F.lit(1)))})
    h = materialize(h, "histogram")  # a row a group, read for sizes and for modes
    near = rows.join(h.select("g", "from", "to", "cut"), "g")
    h = h.join(near.groupBy("g").agg(F.count_if(F.col("x") <= F.col("cut")).alias("size")), "g")
    h = h.join(quantiles(near.filter("x >= from AND x <= to"), {"mode": 0.5}, cuts), "g", "left")
    ok = F.col("way").isNotNull() & (F.col("size") >= F.col("cluster"))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(~F.col("hit"), "no_histogram_first_bin_enrichment"),
            flag(F.col("way") == "pair", "cutoff_estimated_from_first_two_histogram_bins"),
            flag(F.col("way") == "valley", "cutoff_estimated_from_histogram_valley"),
            flag(F.col("way") == "fall", "cutoff_estimated_from_histogram_drop"),
            flag(F.col("way") == "edge", "cutoff_estimated_from_first_histogram_bin"),
            flag(F.col("way").isNotNull() & (F.col("size") < F.col("cluster")), "histogram_early_cluster_too_small"),
            flag(ok & F.col("from_second"), "t0_estimated_as_median_of_second_histogram_bin"),
            flag(ok & ~F.col("from_second"), "t0_estimated_as_median_of_first_histogram_bin"),
        )
    )
    return h.select("g", *[F.when(ok, F.col(k)).alias(k) for k in ("mode", "cut", "depth", "size")], flags.alias("flags"))


def fronts(df: DataFrame, group: str, value: str, p: FrontParams = P, units: str = "minutes") -> DataFrame:
    """(g, n, t0, cutoff, method, confidence, flags) of each group with a valid value; times are in minutes.

    A valley comes first, then a density drop, then the histogram.
    """
    rows = materialize(valid(df, group, value, units), "valid")
    cuts = cuts_of(rows, "x")
    profile, lim = materialize(value_profile(rows, cuts), "profile"), materialize(limits(rows, p, cuts), "limits")
    shape = materialize(shapes(rows, lim, p), "shapes")
    # What each detector finds is a row a group; kept, so that later steps don't run it again.
    valley = mode_valley(rows, shape, lim, p).select("g", F.struct("mode", "cut", "depth", "size").alias("v"))
    drop = density_drop(rows, shape, lim, p).select("g", F.when(F.col("mode").isNotNull(), F.struct("mode", "cut", "depth", "size")).alias("d"), F.col("flags").alias("d_flags"))
    hist = histogram_front(rows, profile, lim, p, cuts).select("g", F.when(F.col("mode").isNotNull(), F.struct("mode", "cut", "depth", "size")).alias("h"), F.col("flags").alias("h_flags"))
    valley, drop, hist = (materialize(x, "found") for x in (valley, drop, hist))
    has_curve = shape.filter("kind = 'curve'").select("g").withColumn("curve", F.lit(True))
    t = profile.join(lim.drop("n"), "g").join(has_curve, "g", "left").join(valley, "g", "left").join(drop, "g", "left").join(hist, "g", "left")
    enough = F.col("n") >= p.min_n
    run = enough & F.coalesce("curve", F.lit(False))
    t = t.withColumn("method", F.when(run & F.col("v").isNotNull(), "first_valley").when(run & F.col("d").isNotNull(), "density_drop").when(run & F.col("h").isNotNull(), "histogram_first_bin"))
    t = t.withColumn("f", F.when(F.col("method") == "first_valley", F.col("v")).when(F.col("method") == "density_drop", F.col("d")).when(F.col("method") == "histogram_first_bin", F.col("h")))
    t = materialize(t, "method")  # a row a group, read again for what the front implies
    early = rows.join(t.filter("many_duplicates").select("g", F.col("f.cut").alias("cut")), "g").filter("x <= cut")
    t = t.join(quantiles(early, {"early_median": 0.5}, cuts), "g", "left")
    pooled = F.col("f").isNotNull() & F.col("many_duplicates") & (F.col("f.size") >= p.min_cluster)
    t = t.withColumn("t0", F.when(pooled, F.col("early_median")).otherwise(F.col("f.mode")))
    t = materialize(t, "front")
    shares = rows.join(t.select("g", F.col("f.cut").alias("cut"), "t0"), "g").groupBy("g").agg(
        F.avg((F.col("x") <= F.col("cut")).cast("double")).alias("cut_share"), F.avg((F.col("x") <= F.col("t0")).cast("double")).alias("t0_share"), F.max("x").alias("top")
    )
    t = t.join(shares, "g")

    hist_won = F.col("method") == "histogram_first_bin"
    none = F.array().cast("array<string>")
    tried_drop, tried_hist = run & F.col("v").isNull(), run & F.col("v").isNull() & F.col("d").isNull()
    base = F.array_compact(
        F.array(
            F.when(F.col("many_duplicates"), F.lit("many_duplicate_rt_values")),
            F.when(F.col("narrow_range"), F.lit("narrow_rt_range")),
            F.when(F.col("early_outlier"), F.lit("possible_early_outlier")),
            F.when(~enough, F.lit("insufficient_data")),
            F.when(enough & ~run, F.lit("kde_failed")),
            F.when(F.col("method") == "first_valley", F.lit("cutoff_estimated_from_first_valley")),
        )
    )
    flags = F.array_distinct(F.concat(base, F.when(tried_drop, F.coalesce("d_flags", none)).otherwise(none), F.when(tried_hist, F.coalesce("h_flags", none)).otherwise(none)))
    t = t.withColumn("flags", flags)
    lost = run & F.col("f").isNull() & ~F.array_contains("flags", "no_early_mode_detected")
    in_time = F.coalesce(hist_won & (F.col("f.mode") <= F.col("max_t0")), F.lit(False))
    second = F.coalesce(hist_won & F.array_contains("flags", "t0_estimated_as_median_of_second_histogram_bin"), F.lit(False))
    kept = F.filter("flags", lambda x: ~((x == "putative_t0_candidate_too_late") & in_time) & ~((x == "possible_early_outlier") & second))
    t = t.withColumn("flags", F.concat(kept, F.when(lost, F.array(F.lit("no_clear_early_valley"))).otherwise(none), F.when(pooled, F.array(F.lit("t0_estimated_as_median_of_early_cluster"))).otherwise(none)))

    most_cut = F.when(hist_won, F.col("top") * p.hist_cutoff_share).otherwise(F.col("top") * p.max_cutoff_share)
    most_share = F.when(F.col("method") == "first_valley", p.max_cutoff_quantile).otherwise(p.late_cutoff_quantile)
    low = (
        (F.col("f.depth") < p.min_valley_depth) | (F.col("f.size") < F.col("cluster")) | (F.col("cut_share") > most_share) | (F.col("t0") > F.col("max_t0"))
        | (F.col("f.cut") > most_cut) | F.array_contains("flags", "possible_early_outlier")
    )
    clear = (F.col("f.depth") >= 0.40) & (F.col("f.size") >= p.min_cluster) & ~F.col("narrow_range") & (F.col("t0") < F.col("f.cut"))
    confidence = (
        F.when(~enough, "insufficient_data").when(F.col("f").isNull() | low, "low")
        .when(F.col("method") != "first_valley", F.when(clear, "medium").otherwise("low"))
        .when(clear & (F.col("t0_share") <= p.max_t0_quantile), "high").otherwise("medium")
    )
    return t.select("g", "n", "t0", F.col("f.cut").alias("cutoff"), "method", confidence.alias("confidence"), F.array_join("flags", "; ").alias("flags"))


def classify(df: DataFrame, found: DataFrame, group: str, value: str, p: FrontParams = P, units: str = "minutes") -> DataFrame:
    """Add pseudo_k and status to each row; a value equal to the cut-off is not retained, one that isn't valid is uncertain."""
    f = found.select(F.col("g").alias(group), "t0", "cutoff", "confidence")
    x, k = in_minutes(F.col(value).cast("double"), units), F.col("pseudo_k")
    rows = df.join(f, group, "left").withColumn("pseudo_k", F.when(F.col("t0") > 0, (x - F.col("t0")) / F.col("t0")))
    status = (
        F.when(x.isNull() | (x <= 0) | (x >= float("inf")) | F.col("t0").isNull() | F.col("cutoff").isNull() | (F.col("confidence") == "low"), "uncertain")
        .when(x <= F.col("cutoff"), "putatively_non_retained").when(k < p.weak_k, "weakly_retained").when(k >= p.weak_k, "retained").otherwise("uncertain")
    )
    return rows.withColumn("status", status).select(*df.columns, "pseudo_k", "status")


def classify_simple(df: DataFrame, value: str, cutoff: str) -> DataFrame:
    """Status by the cut-off alone; a value equal to it is retained, a null value is not."""
    status = F.when(F.col(cutoff).isNull(), "uncertain").when(F.col(value) >= F.col(cutoff), "retained").otherwise("non_retained")
    return df.withColumn("status", status)
