"""Error metrics: global, by group, over folds, weighted."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.scalar import errors
from cohortry.sources.shared import materialize

METRICS = ["mae", "rmse", "mre", "rel_error_max", "rel_error_mean"]


def row_errors(df: DataFrame, y: str, predicted: str, greatest: str, mean: str) -> DataFrame:
    return df.withColumns(errors(F.col(y), F.col(predicted), F.col(greatest), F.col(mean)))


def metric_columns() -> list[Column]:
    """Aggregates over rows with error columns."""
    return [
        F.count("*").alias("n"),
        F.avg("diff").alias("mae"),
        F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse"),
        F.avg("mre").alias("mre"),
        F.avg("rel_error_max").alias("rel_error_max"),
        F.avg("rel_error_mean").alias("rel_error_mean"),
    ]


def metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Metrics of all rows, or of each key."""
    return df.groupBy(*keys).agg(*metric_columns())


def metrics_by_each(df: DataFrame, first: str, second: str) -> DataFrame:
    """Metrics by one key, by another, and of all rows, in one pass; ``level`` tells which."""
    rows = df.groupingSets([[F.col(first)], [F.col(second)], []], first, second)
    level = F.when(F.grouping(first) == 0, first).when(F.grouping(second) == 0, second).otherwise("all")
    return rows.agg(level.alias("level"), *metric_columns())


def weighted(df: DataFrame, metrics_: list[str], weight: str, keys: list[str] = ()) -> DataFrame:
    """(keys, metric, mean, std): weighted means and population deviations, in long form.

    The deviation is taken around the mean in a second aggregation, since a difference of squares
    would lose its digits; the metrics, a row a group, are written first, so that what they come from runs once.
    """
    ids = [*keys, weight]
    long = materialize(df.select(*ids, *metrics_), "metrics").unpivot(ids, metrics_, "metric", "x")
    by = [*keys, "metric"]
    w = F.col(weight)
    means = long.groupBy(*by).agg(F.try_divide(F.sum(w * F.col("x")), F.sum(F.when(F.col("x").isNotNull(), w))).alias("mean"))
    spread = long.join(means, by).groupBy(*by, "mean").agg(
        F.sqrt(F.try_divide(F.sum(w * F.pow(F.col("x") - F.col("mean"), F.lit(2))), F.sum(F.when(F.col("x").isNotNull(), w)))).alias("std")
    )
    return spread.select(*by, "mean", "std")


def two_level(df: DataFrame, metrics_: list[str], weight: str, fold: str) -> DataFrame:
    """Weighted over the groups of each fold first, then over folds by their rows."""
    inner = df.groupBy(fold).agg(F.sum(weight).alias(weight), *[F.try_divide(F.sum(F.col(weight) * F.col(m)), F.sum(weight)).alias(m) for m in metrics_])
    return weighted(inner, metrics_, weight)


def fold_summary(df: DataFrame, fold: str, k: int) -> DataFrame:
    """Metrics of each fold with the number of the fold that it is validated on, in long form."""
    per = metrics(df, fold).withColumn("val_fold", F.pmod(F.col(fold) + 1, F.lit(k)).cast("int"))
    return per.unpivot([fold, "val_fold", "n"], METRICS, "metric", "value")


def r2_score(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """1 - residual over total sum of squares; not the squared correlation."""
    mean = df.agg(F.avg(y).alias("_m"))
    rows = df.crossJoin(F.broadcast(mean))
    sq = lambda x: F.sum(x * x)
    return rows.agg((1 - F.try_divide(sq(F.col(y) - F.col(predicted)), sq(F.col(y) - F.col("_m")))).alias("r2"))


def metrics_excluding(df: DataFrame, keep: DataFrame, key: str, fold: str) -> DataFrame:
    """Metrics of each fold over the rows whose key ``keep`` lists."""
    return metrics(df.join(keep.select(key), key, "left_semi"), fold)


def regression_by_group_fold(df: DataFrame, group: str, fold: str, x: str, y: str, k: int) -> DataFrame:
    """Per group and fold: intercept and slope fitted without the fold and its validation fold.

    Sums of each (group, fold) are subtracted from the group's, so no fold is read twice.
    """
    own = df.groupBy(group, fold).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy")
    )
    sums = ["n", "sx", "sy", "sxx", "sxy"]
    total = own.groupBy(group).agg(*[F.sum(s).alias(f"t_{s}") for s in sums])
    val = own.select(group, F.pmod(F.col(fold) - 1, F.lit(k)).cast("int").alias(fold), *[F.col(s).alias(f"v_{s}") for s in sums])
    rows = own.join(total, group).join(val, [group, fold], "left")
    rest = {s: F.col(f"t_{s}") - F.col(s) - F.coalesce(F.col(f"v_{s}"), F.lit(0)) for s in sums}
    rows = rows.select(group, fold, F.col("n").alias("n_test"), *[e.alias(f"r_{s}") for s, e in rest.items()])
    n, sx, sy, sxx, sxy = (F.col(f"r_{s}") for s in sums)
    slope = F.try_divide(n * sxy - sx * sy, F.nullif(n * sxx - sx * sx, F.lit(0.0)))
    return rows.withColumn("slope", slope).select(group, fold, "n_test", n.alias("n_train"), "slope", F.try_divide(sy - F.col("slope") * sx, n).alias("intercept"))


def regressions_by_group_fold(df: DataFrame, group: str, fold: str, features: list[str], y: str, k: int) -> DataFrame:
    """Per group and fold: intercept and a weight for each feature, by least squares without the fold and its validation fold.

    Sums and products of each (group, fold) are subtracted from the group's, so no fold is read twice,
    and the small systems of many groups are solved together.  Products are taken around the group's
    means, which keeps their digits.  Rows that lack a feature or ``y`` are left out of the fit; a group whose features
    depend on each other in what is left has no weights and no intercept.
    """
    names = [*features, y]
    ids = [F.col(group).alias("_g"), F.col(fold).alias("_f")]
    known = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    m = len(names)
    means = known.groupBy("_g").agg(*[F.avg(f"_{i}").alias(f"_m{i}") for i in range(m)])
    full = sum((F.col(f"_{i}").isNull().cast("int") for i in range(m)), F.lit(0)) == 0
    rows = known.join(means, "_g").select("_g", "_f", full.alias("_full"), *[(F.col(f"_{i}") - F.col(f"_m{i}")).alias(f"_{i}") for i in range(m)])
    terms = [F.lit(1.0), *[F.col(f"_{i}") for i in range(m)]]
    pairs = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    sums = [F.coalesce(F.sum(F.when(F.col("_full"), terms[i] * terms[j])), F.lit(0.0)) for i, j in pairs]
    own = rows.groupBy("_g", "_f").agg(F.count("*").alias("_n"), F.array(*sums).alias("_s"))
    per_fold = own.groupBy("_g").agg(F.array(*[F.sum(F.col("_s")[i]) for i in range(len(pairs))]).alias("_t"))
    val = own.select("_g", F.pmod(F.col("_f") - 1, F.lit(k)).cast(own.schema["_f"].dataType).alias("_f"), F.col("_s").alias("_v"))
    met = own.join(per_fold, "_g").join(val, ["_g", "_f"], "left").join(means, "_g")
    rest = F.transform(F.arrays_zip("_t", "_s", F.coalesce("_v", F.transform("_s", lambda x: x * 0)).alias("_v")), lambda x: x["_t"] - x["_s"] - x["_v"])
    solved = met.select("_g", "_f", "_n", _solve(rest, F.array(*[F.col(f"_m{i}") for i in range(m)])).alias("w"))
    found = F.col("w.weights")
    return solved.select(F.col("_g").alias(group), F.col("_f").alias(fold), F.col("_n").alias("n_test"), "w.n_train", "w.intercept", found.alias("weights"))


@F.pandas_udf(T.StructType([T.StructField("n_train", T.LongType()), T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType()))]))
def _solve(sums: pd.Series, means: pd.Series) -> pd.DataFrame:
    """Least squares of many systems given by the upper triangles of their products of (1, features, y), all around ``means``."""
    s = np.stack(sums.to_list()).astype(float)
    size = int((math.sqrt(8 * s.shape[1] + 1) - 1) / 2)
    full = np.zeros((len(s), size, size))
    i, j = np.triu_indices(size)
    full[:, i, j] = full[:, j, i] = s
    n = full[:, 0, 0]
    with np.errstate(all="ignore"):
        centre = full[:, 0, 1:] / n[:, None]
        cov = full[:, 1:, 1:] - n[:, None, None] * centre[:, :, None] * centre[:, None, :]
        a, b = cov[:, :-1, :-1], cov[:, :-1, -1]
        scale = np.sqrt(np.diagonal(a, axis1=1, axis2=2))
        unit = a / (scale[:, :, None] * scale[:, None, :])
    good = np.isfinite(unit).all(axis=(1, 2)) & (n > size - 1)
    # Scaled to ones on the diagonal; a least eigenvalue of nearly none means that features depend on each other.
    good[good] = np.linalg.eigvalsh(unit[good])[:, 0] > 1e-10 if good.any() else []
    w = np.full((len(s), size - 2), np.nan)
    if good.any():
        w[good] = np.linalg.solve(unit[good], (b[good] / scale[good])[:, :, None])[:, :, 0] / scale[good]
    at = np.stack([np.asarray(x, float) for x in means]) + centre
    intercept = at[:, -1] - (w * at[:, :-1]).sum(axis=1)
    return pd.DataFrame({"n_train": n.round().astype("int64"), "intercept": [float(x) if g else None for x, g in zip(intercept, good, strict=True)], "weights": [list(map(float, x)) if g else None for x, g in zip(w, good, strict=True)]})


def predict_by_group_fold(df: DataFrame, fits: DataFrame, group: str, fold: str, features: list[str]) -> DataFrame:
    """``df`` with ``predicted``, each row by the model that has not seen its fold; null without a model."""
    models = fits.select(group, fold, "intercept", "weights")
    terms = [F.col("weights")[i] * F.col(f"`{f}`").cast("double") for i, f in enumerate(features)]
    return df.join(models, [group, fold], "left").withColumn("predicted", sum(terms, F.col("intercept"))).drop("intercept", "weights")


def pooled_models(df: DataFrame, roles: DataFrame, features: list[str], y: str, fold: str) -> DataFrame:
    """Predictions of held-out folds by one linear model per run; ``roles`` maps (run, fold) to a role.

    The model is least squares by normal equations: each run's moments are one small row, and
    only those reach the driver.
    """
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    m = len(terms)
    joined = df.join(F.broadcast(roles), fold)
    moments = [F.sum(terms[i] * terms[j]) for i in range(m) for j in range(m)] + [F.sum(t * F.col(y)) for t in terms]
    fitted = joined.filter("role = 'train'").groupBy("run").agg(F.array(*moments).alias("s")).collect()  # one row a run
    table = []
    for run, s in fitted:
        a, b = np.array(s[: m * m]).reshape(m, m), np.array(s[m * m :])
        table.append((run, [float(v) for v in np.linalg.lstsq(a, b, rcond=None)[0]]))
    spark = df.sparkSession
    models = spark.createDataFrame(table, "run int, w array<double>")
    predicted = sum((F.col("w")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    return joined.filter("role = 'test'").join(F.broadcast(models), "run").withColumn("predicted", predicted).drop("w")
