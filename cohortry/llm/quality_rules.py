"""Quality classifier as a sparse ensemble of rules.

Statistics of a text are Spark columns.  Shallow trees, fitted to labelled rows, give their
paths as conjunctive rules over the statistics; a lasso logistic regression keeps few of them;
and what it keeps is compiled into one Spark column, so scoring needs no Python.

The trees and weights are fitted to at most ``MAX_LABELLED`` labelled rows, chosen by a hash of
their id; all documents are scored over their whole texts.

Defined results: a null text counts as empty and is scored like any; where the labels hold one
class only, or none, every score is that class's smoothed share; repeated rows are scored
alike; an empty table gives an empty result; further columns are kept by ``filter_quality``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import SPACES, columns_of, free_name, materialize

#: Labelled rows that are fitted at most.
MAX_LABELLED = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.0005, 42


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; none is null."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars, words, lines = F.char_length(t).cast("double"), count(r"[^\x20\x09-\x0D]+"), count(r"[^\n]+")
    share = lambda n, of: n / F.greatest(of, F.lit(1.0))
    upper, marks = count(r"\p{Lu}"), count(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'\"()-]")
    distinct = lambda pattern: F.size(F.array_distinct(F.split(t, pattern))).cast("double")
    return {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(words),
        "word_length": share(chars - count(r"[\x20\x09-\x0D]"), words),
        "upper_share": share(upper, chars),
        "digit_share": share(count("[0-9]"), chars),
        "mark_share": share(marks, chars),
        "bang_share": share(count("!"), words),
        "pipe_share": share(count(r"\|"), words),
        "stop_share": share(count(r"[.,]"), words),
        "short_share": share(count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])"), words),
        "letter_share": share(count(r"\p{L}"), chars),
        "words_a_line": share(words, lines),
        "distinct_lines": share(distinct("\n"), F.greatest(lines, F.lit(1.0))),
        "distinct_words": share(distinct(SPACES), words),
        "lower_starts": share(count(r"(?m)^\p{Ll}"), lines),
    }


#: In the order of the fitted features.
NAMES = [
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "mark_share", "bang_share", "pipe_share",
    "stop_share", "short_share", "letter_share", "words_a_line", "distinct_lines", "distinct_words", "lower_starts",
]


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (name of a statistic, whether it is an upper bound, threshold)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self, stats) -> Column:
        parts = [stats(name) <= F.lit(at) if upper else stats(name) > F.lit(at) for name, upper, at in self.bounds]
        return reduce(lambda a, b: a & b, parts).cast("double")


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``score`` gives the probability of label 1 as a column."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats) -> Column:
        total = reduce(lambda a, b: a + b, [F.lit(w) * r.column(stats) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(text: str, names: list[str]) -> set[Rule]:
    """Every path from the root of a printed decision tree, as rules."""
    rules, path = set(), []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)", line)
        if m:
            path = [p for p in path if p[0] < len(m[1])]  # deeper lines are indented further
            path.append((len(m[1]), (names[int(m[3])], m[4] == "<=", float(m[5]))))
            rules.add(Rule(tuple(sorted({b for _, b in path}))))
    return rules


def lasso_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = LASSO, rounds: int = 3000) -> tuple[float, np.ndarray]:
    """(intercept, weights) that minimise the mean logistic loss plus ``penalty`` times the weights' absolute sum.

    ``n`` counts equal rows.  Accelerated proximal gradient steps; the intercept isn't penalised.
    """
    a, share = np.column_stack([np.ones(len(x)), x]), n / n.sum()
    step = 4.0 / np.linalg.eigvalsh((a * share[:, None]).T @ a)[-1]
    shrink = np.r_[0.0, np.full(x.shape[1], penalty * step)]
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        slope = a.T @ (share * (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y))
        moved = z - step * slope
        after, t_after = np.sign(moved) * np.maximum(0.0, np.abs(moved) - shrink), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = after + (t - 1) / t_after * (after - w)
        if np.abs(after - w).max() < 1e-7:
            w = after
            break
        w, t = after, t_after
    return float(w[0]), w[1:]


def fit(rows: DataFrame, label: str = "label") -> RuleModel:
    """Rules and weights from ``rows`` (NAMES and ``label``), MAX_LABELLED of them at most.

    Trees are grown by Spark ML.  The weights need only how often each pattern of fired rules
    occurs with each label; those counts, at most a row per labelled row, go to the driver.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = rows.agg(F.count("*"), F.sum(label)).first()
    ones = ones or 0
    prior = (ones + 1) / (n + 2)
    if ones in (0, n):
        return RuleModel(float(np.log(prior / (1 - prior))), ())
    plain = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.select(F.col(label).cast("double").alias("label"), *NAMES))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(plain)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, NAMES)}, key=lambda r: r.bounds)
    if not rules:
        return RuleModel(float(np.log(prior / (1 - prior))), ())
    fired = F.array_join(F.array(*[r.column(F.col).cast("int") for r in rules]), "")
    seen = rows.groupBy(fired.alias("fired"), F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy("fired", "label").toPandas()
    x = np.array([list(map(float, s)) for s in seen["fired"]])
    intercept, weights = lasso_logistic(x, seen["label"].to_numpy(float), seen["n"].to_numpy(float))
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learnable(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label): at most MAX_LABELLED labelled rows of ``ids`` that aren't held out, by a hash of the id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1)")
    own = own.filter(~is_held_out(F.col("doc_id")))
    known = own.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return materialize(known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "label").limit(MAX_LABELLED), "labelled")


def train(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """Fit to labelled rows of ``stats`` (doc_id and NAMES)."""
    rows = stats.join(F.broadcast(learnable(stats, labels)), "doc_id")  # MAX_LABELLED rows
    return fit(materialize(rows.select("label", *NAMES).repartition(2), "learnt"))


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, statistics...) of each row, written once."""
    stats = statistics(F.col("text").cast("string"))
    return materialize(docs.select(F.col(key).cast("long").alias("doc_id"), *[stats[n].alias(n) for n in NAMES]), "statistics")


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents scored under ``least``; same columns, no shuffle of texts."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = ids.join(F.broadcast(learnable(ids, labels)), "doc_id").select("doc_id", "text")  # statistics of these alone are fitted
    model = train(with_statistics(some), labels)
    name, fence = free_name(docs, "_stats"), free_name(docs, "_fence")
    stats = statistics(F.col("text").cast("string"))
    # A projection with a generated number stays below the filter that reads it.  Without it the
    # optimiser would copy the statistics' expressions into each of the hundreds of bounds.
    rows = docs.select(*columns_of(docs), F.struct(*[stats[n].alias(n) for n in NAMES]).alias(name), F.monotonically_increasing_id().alias(fence))
    passes = (model.score(lambda n: F.col(name)[n]) >= least) & (F.col(fence) >= 0)
    return rows.filter(passes).select(*columns_of(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    stats = with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = stats.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), model.score(F.col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
