"""Feature scaling and reshaping."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(train: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """One row with mean and population deviation (1 for a constant) of each column.

    With ``group`` a group counts once: its columns are conditions, equal in all its rows.
    """
    rows = train.groupBy(group).agg(*[F.first(c).alias(c) for c in columns]) if group else train
    mean = [F.avg(c).alias(f"_m_{c}") for c in columns]
    spread = [F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"_s_{c}") for c in columns]
    return rows.agg(*mean, *spread)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus mean over deviation; the scaler is one broadcast row."""
    joined = df.crossJoin(F.broadcast(scaler))
    scaled = joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns})
    return scaled.select(*df.columns)


def feature_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """The columns, in the given order, as one array of doubles."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def pivot_segments(segs: DataFrame, source: str, fields: list[str], most: int) -> DataFrame:
    """``<field>_<i>`` for the first ``most`` segments of each source; absent ones are null."""
    at = lambda f, i: F.get(F.col("segs"), F.lit(i))[f].alias(f"{f}_{i}")
    return segs.select(source, *[at(f, i) for i in range(most) for f in fields])


def elastic_net(cov: np.ndarray, target: np.ndarray, penalty: float, mix: float, tolerance: float = 1e-12, most: int = 100_000) -> np.ndarray:
    """Weights of least squares over half the mean square error plus ``penalty`` times (``mix`` |w| + (1 - mix) w w / 2).

    Coordinate descent on the features' covariances and theirs with the target; constant features have no weight.
    """
    w, grad = np.zeros(len(target)), target.copy()  # grad: covariance of each feature with what is left
    used = [j for j in range(len(target)) if cov[j, j] > 0]
    scale = max(1e-300, np.abs(target).max(initial=0.0))
    for _ in range(most):
        change = 0.0
        for j in used:
            x = grad[j] + cov[j, j] * w[j]
            new = math.copysign(max(0.0, abs(x) - penalty * mix), x) / (cov[j, j] + penalty * (1 - mix))
            if new != w[j]:
                grad -= cov[:, j] * (new - w[j])
                change = max(change, abs(new - w[j]) * math.sqrt(cov[j, j]))
                w[j] = new
        if change <= tolerance * scale:
            break
    return w


def grid_search(train: DataFrame, val: DataFrame, features: list[str], y: str, penalties: list[float], mixes: list[float]) -> DataFrame:
    """Trials of penalised linear models on standardised features, by mean square error on ``val``.

    One pass over ``train`` gives means and covariances, one over ``val`` its products around those
    means; every trial is fitted and judged from these, however many there are.  A model has least half mean square error plus
    ``penalty`` times (``mix`` |w| + (1 - mix) w w / 2) over weights of features of deviation 1; the intercept is free.
    Rows that lack a feature or ``y`` are left out.
    """
    columns = [F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate([*features, y])]
    names, p = [f"_{i}" for i in range(len(columns))], len(features)
    a, b = (d.select(*columns).dropna() for d in (train, val))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    first = a.agg(F.count("*"), *[F.avg(n) for n in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    if not first[0]:
        raise ValueError("no row to train on")
    mean, cov = first[1 : p + 2], np.zeros((p + 1, p + 1))
    for (i, j), v in zip(pairs, first[p + 2 :], strict=True):
        cov[i, j] = cov[j, i] = v
    around = [F.lit(1.0), *[F.col(n) - F.lit(m) for n, m in zip(names, mean, strict=True)]]
    sides = [(i, j) for i in range(p + 2) for j in range(i, p + 2)]
    second = b.agg(*[F.sum(around[i] * around[j]) for i, j in sides]).first()
    held = np.zeros((p + 2, p + 2))
    for (i, j), v in zip(sides, second, strict=True):
        held[i, j] = held[j, i] = v or 0.0
    deviation = np.sqrt(np.diagonal(cov)[:p])
    scale = np.where(deviation > 0, deviation, 1.0)
    unit, target = cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale
    trials = []
    for penalty in penalties:
        for mix in mixes:
            w = elastic_net(unit, target, penalty, mix) / scale
            left = np.array([0.0, *-w, 1.0])  # what is left of y, around the means
            trials.append((float(penalty), float(mix), float(left @ held @ left / held[0, 0]) if held[0, 0] else None))
    return train.sparkSession.createDataFrame(trials, "penalty double, mix double, val_loss double").orderBy("val_loss", "penalty", "mix")
