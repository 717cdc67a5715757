"""Regression trees of many cross-validation runs, grown together.

Features are binned once, with cuts that all runs share.  A level of every run's tree then
comes from one aggregation of counts and sums by (run, node, feature, bin), combined on the map
side, so that a level is one pass over the rows however many runs and nodes there are, and no
task holds a node's rows.  Splits and leaves are small tables: runs times nodes of a level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.ranks import bucket_of
from cohortry.sources.shared import materialize

#: Share of a node's sum of squares that a split must explain; less is noise of summation.
NOISE = 1e-12
#: Greatest depth; a level's splits are broadcast, at most 2 ** depth a run.
MOST = 12


@dataclass(frozen=True)
class Trees:
    """Fitted trees: the splits of each level (_run, _node, _feature, _cut, _gain, _n), and leaves (_run, _node, _leaf)."""

    features: list[str]
    cuts: dict[str, list[float]]
    levels: list[DataFrame]
    leaves: DataFrame

    def splits(self) -> DataFrame:
        """(run, node, feature, threshold, gain, n): rows of a node under the threshold go to node 2 node + 1, others to 2 node + 2."""
        spark = self.leaves.sparkSession
        places = [(i, j + 1, f, float(c)) for i, f in enumerate(self.features) for j, c in enumerate(self.cuts[f])]
        named = F.broadcast(spark.createDataFrame(places, "_feature int, _cut int, feature string, threshold double"))  # features times bins
        rows = [s.join(named, ["_feature", "_cut"]) for s in self.levels]
        out = spark.createDataFrame([], "run int, node int, feature string, threshold double, gain double, n long")
        for r in rows:
            out = out.union(r.select("_run", "_node", "feature", "threshold", "_gain", "_n"))
        return out

    def predict(self, df: DataFrame, roles: DataFrame, fold: str, role: str = "test") -> DataFrame:
        """Rows of ``df`` in the folds that have ``role`` in a run, with ``run`` and ``predicted``; null where the run had no row to learn from.

        Columns of ``df`` with these two names are replaced.
        """
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("run", "predicted")]).alias("_row"), F.col(f"`{fold}`").alias("_fold"), _bins(self.features, self.cuts).alias("_bins"))
        met = rows.join(F.broadcast(_runs(roles, role)), "_fold").withColumn("_node", F.lit(0))
        placed = _descend(met, self.levels).join(F.broadcast(self.leaves), ["_run", "_node"], "left")
        return placed.select("_row.*", F.col("_run").alias("run"), F.col("_leaf").alias("predicted"))


def even_cuts(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Up to ``bins`` - 1 ascending cuts a feature, at even shares of the rows (a merged quantile sketch), in one pass."""
    if bins < 2:
        raise ValueError("two bins or more")
    shares = F.lit([k / bins for k in range(1, bins)])
    found = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, F.lit(100 * bins)) for f in features]).first()
    return {f: sorted({v for v in q or [] if v == v}) for f, q in zip(features, found, strict=True)}


def grow(
    df: DataFrame, roles: DataFrame, features: list[str], y: str, fold: str, depth: int = 4, bins: int = 64, least: int = 20, cuts: dict[str, list[float]] | None = None
) -> Trees:
    """A tree for each run of ``roles`` (run, fold, role), from the rows of its training folds.

    A node is cut where the squares around its two means are least, if both sides have ``least`` rows;
    of equal cuts the first feature's, then the lowest, is taken.  ``cuts`` are by default at even shares of all rows, whatever their fold, since they
    don't see ``y``.  A null feature is under every cut and NaN over every one.  Rows whose ``y`` is null or
    not finite teach nothing, and a run without others has no tree.  A depth of 0 gives means.
    """
    if not 0 <= depth <= MOST:
        raise ValueError(f"depth is 0 to {MOST}")
    cuts = even_cuts(df, features, bins) if cuts is None else cuts
    target = F.col(f"`{y}`").cast("double")
    known = df.filter(target.isNotNull() & ~F.isnan(target) & (F.abs(target) < F.lit(float("inf"))))
    rows = materialize(known.select(F.col(f"`{fold}`").alias("_fold"), target.alias("_y"), _bins(features, cuts).alias("_bins")), "binned")  # read by each level
    mean = rows.agg(F.avg("_y")).first()[0] or 0.0  # sums are taken around it, which keeps their digits
    taught = rows.withColumn("_y", F.col("_y") - mean).join(F.broadcast(_runs(roles, "train")), "_fold").withColumn("_node", F.lit(0))
    levels: list[DataFrame] = []
    for level in range(depth):
        levels.append(materialize(_best(_descend(taught, levels).filter(F.col("_node") >= 2**level - 1), least), "splits"))
    leaves = _descend(taught, levels).groupBy("_run", "_node").agg((F.avg("_y") + mean).alias("_leaf"))
    return Trees(list(features), cuts, levels, materialize(leaves, "leaves"))


def _bins(features: list[str], cuts: dict[str, list[float]]) -> Column:
    """The bin of each feature: how many of its cuts are no greater."""
    return F.array(*[bucket_of(f"`{f}`", [float(c) for c in cuts[f]]) for f in features])


def _runs(roles: DataFrame, role: str) -> DataFrame:
    """(_run, _fold) of the folds that have the role; runs times folds."""
    return roles.filter(F.col("role") == role).select(F.col("run").alias("_run"), F.col("fold").alias("_fold"))


def _descend(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Move each row of a run down the splits; a level has at most runs times its nodes, so it is broadcast."""
    for splits in levels:
        met = rows.join(F.broadcast(splits.select("_run", "_node", "_feature", "_cut")), ["_run", "_node"], "left")
        side = (F.get("_bins", F.col("_feature")) >= F.col("_cut")).cast("int")
        rows = met.withColumn("_node", F.when(F.col("_feature").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + 1 + side)).drop("_feature", "_cut")
    return rows


def _best(rows: DataFrame, least: int) -> DataFrame:
    """The best cut of each node that has one."""
    each = rows.select("_run", "_node", "_y", F.posexplode("_bins").alias("_feature", "_bin"))
    sums = each.groupBy("_run", "_node", "_feature", "_bin").agg(F.count("*").alias("k"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
    of = Window.partitionBy("_run", "_node", "_feature")  # a row a bin
    upto = of.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    c = sums.select(
        "_run",
        "_node",
        "_feature",
        (F.col("_bin") + 1).alias("_cut"),
        F.sum("k").over(upto).alias("kl"),
        F.sum("s").over(upto).alias("sl"),
        F.sum("k").over(of).alias("_n"),
        F.sum("s").over(of).alias("s"),
        F.sum("q").over(of).alias("q"),
    )
    kr, sr = F.col("_n") - F.col("kl"), F.col("s") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / F.col("kl") + F.try_divide(sr * sr, kr) - F.col("s") * F.col("s") / F.col("_n")
    fit = c.withColumn("_gain", gain).filter((F.col("kl") >= max(1, least)) & (kr >= max(1, least)) & (F.col("_gain") > NOISE * F.col("q")))
    first = F.min(F.struct((-F.col("_gain")).alias("loss"), "_feature", "_cut", "_n")).alias("b")
    best = fit.groupBy("_run", "_node").agg(first)
    return best.select("_run", "_node", "b._feature", "b._cut", (-F.col("b.loss")).alias("_gain"), "b._n")
