"""Temperature mixing of sources under a token budget.

Each source's share of all tokens is raised to an exponent and the results are normalised:
1 keeps the natural mix, 0 makes it even, and more than 1 makes it steeper.  Bisection finds the
exponent whose mix has the target entropy, wherever above 0 it lies; if that mix would repeat a
source more than ``max_repeats`` times, bisection between it and the natural mix finds the one
that just doesn't.  ``bound`` names what decided.  The weights are realised by block
permutations: each pass over a source takes its blocks of documents in a new random order, and
the last, partial pass stops at the document that meets the source's budget.

Sources are rows of a table, however many there are.  Each pass over it gives the moments of
31 exponents, which is five halvings, and only those numbers reach the driver.  Documents are
never dropped for skew: hot sources are dealt into blocks of bounded size, and running sums go
over buckets of blocks, blocks, and then within a block.  DataFrame functions only.

Defined results: null texts have no tokens; a null source is a source of its own; documents
without tokens come with every full pass of their source; equal sources, or a single one, keep
the natural mix; a target below what even the steepest mix has is met as far as exponent 1024
goes; repeated rows are rows of their own; documents of equal random keys are in order of
their row; an empty table gives an empty result; long texts are counted whole; further columns,
of any name, are kept by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import attach, columns_of, free_name, keyed, materialize, words_count
from cohortry.operators.ranks import hex_bucket, running

#: Without a target: the entropy lies this share of the way from the natural to the even mix.
FLATTEN, MAX_REPEATS, SEED = 0.5, 4.0, 42
#: Documents that one block holds on average, halvings at a pass, passes, the steepest exponent.
BLOCK, AT_ONCE, PASSES, STEEPEST = 2048, 5, 10, 1024.0


def _moments(sources: DataFrame, top: int, exponents: list[float]) -> list[tuple[float, float]]:
    """(S, H) at each exponent a: the sum of q^a, where q is a source's tokens over the greatest, and the mix's entropy."""
    q = F.col("tokens") / F.lit(float(top))
    sums = [x for a in exponents for x in (F.sum(F.pow(q, F.lit(a))), F.sum(F.pow(q, F.lit(a)) * F.ln(q)))]
    found = list(sources.filter("tokens > 0").agg(*[s.alias(f"x{k}") for k, s in enumerate(sums)]).first())
    return [(s, math.log(s) - a * t / s) for a, s, t in zip(exponents, found[::2], found[1::2], strict=True)]


def _bisect(holds: Callable[[list[float]], list[bool]], low: float, high: float) -> float:
    """Where ``holds`` turns true between ``low``, where it is false, and ``high``."""
    for _ in range(PASSES):
        points = [low + (high - low) * k / 2**AT_ONCE for k in range(2**AT_ONCE + 1)]
        first = [*holds(points[1:-1]), True].index(True) + 1
        low, high = points[first - 1], points[first]
    return high


def find_exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None, flatten: float = FLATTEN) -> tuple[float, str]:
    """(exponent, bound) for (source, tokens) of each source; bound is entropy, repeats, steepest or natural."""
    total, n, low, top = sources.filter("tokens > 0").agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n or low == top:
        return 1.0, "natural"
    at = lambda a: _moments(sources, top, [a])[0]
    natural = at(1.0)[1]
    target = natural + flatten * (math.log(n) - natural) if target_entropy is None else target_entropy * math.log(n)
    reached, bound = 0.0, "entropy"
    if target < math.log(n):
        under, over = 0.0, 1.0
        while at(over)[1] > target and over < STEEPEST:
            under, over = over, 2 * over
        if at(over)[1] > target:
            reached, bound = over, "steepest"
        else:
            reached = _bisect(lambda xs: [h <= target for _, h in _moments(sources, top, xs)], under, over)

    def fits(exponents: list[float]) -> list[bool]:
        """Whether no source is repeated too often; by size the smallest comes most often below 1, the largest above."""
        out = []
        for a, (s, _) in zip(exponents, _moments(sources, top, exponents), strict=True):
            log_most = max(0.0, (1 - a) * math.log(top / low))  # of q^(a-1)
            log_least = min(0.0, (1 - a) * math.log(top / low))
            log_passes = log_most - log_least if budget is None else log_most + math.log(budget / (s * top))
            out.append(log_passes <= math.log(max_repeats) + 1e-12)
        return out

    if not fits([reached])[0]:
        reached, bound = _bisect(fits, reached, 1.0), "repeats"
    return round(reached, 9), bound


def source_weights(sources: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(source, tokens, docs, exponent, bound, weight, passes) for (source, tokens, docs) of each source.

    ``budget`` is the number of tokens of the mix, by default the least with which each source
    is taken at least once, so that no document is lost.  A budget below that takes part of
    the sources that are over their share; one that no mix can hold within ``max_repeats``
    keeps the natural mix, which repeats least.
    """
    exponent, bound = find_exponent(sources, target_entropy, max_repeats, budget, flatten)
    has = F.col("tokens") > 0
    top = sources.agg(F.max("tokens").cast("double").alias("_top"), F.min(F.when(has, F.col("tokens"))).cast("double").alias("_low"))
    q = F.col("tokens") / F.col("_top")
    one = sources.crossJoin(F.broadcast(top)).withColumn("_q", F.when(has, q))
    total = one.agg(F.sum(F.pow("_q", F.lit(exponent))).alias("_s"))
    rows = one.crossJoin(F.broadcast(total))  # one row each
    per_token = F.pow("_q", F.lit(exponent - 1))
    if budget is None:
        passes = per_token / F.least(F.lit(1.0), F.pow(F.col("_low") / F.col("_top"), F.lit(exponent - 1)))
    else:
        passes = per_token * F.lit(float(budget)) / (F.col("_s") * F.col("_top"))
    weight = F.coalesce(F.pow("_q", F.lit(exponent)) / F.col("_s"), F.lit(0.0))
    return rows.select("source", "tokens", "docs", F.lit(exponent).alias("exponent"), F.lit(bound).alias("bound"), weight.alias("weight"), F.round(F.coalesce(passes, F.lit(1.0)), 9).alias("passes"))


def _digest(*parts: Column | str | int) -> Column:
    """A random order that the parts determine, as hexadecimal digits; any engine with md5 has the same."""
    columns = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def _number(digest: Column) -> Column:
    """The first 52 bits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _uniform(digest: Column) -> Column:
    """A random number from 0 to 1."""
    return _number(digest) * F.lit(2.0**-52)


def realise(rows: DataFrame, weights: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(_row, source, tokens, pass, place) of each time that a document is taken.

    ``rows`` has _row, source and tokens.  Full passes take every document.  The partial pass
    takes whole blocks in their order while they fit the budget, then documents of the next
    block until the budget is met.  ``place`` orders the mix: every stretch of it holds the
    sources at their weights.
    """
    source = F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name")).alias("_source")
    table = weights.select(source, "passes", F.col("tokens").alias("all_tokens"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).alias("blocks"))
    dealt = attach(rows.select("*", source), table, ["_source"], "_row").withColumn("full", F.floor("passes").cast("int"))
    dealt = dealt.withColumn("block", F.pmod(_number(_digest("_row", seed)), F.col("blocks")))
    dealt = materialize(dealt, "dealt")
    whole = dealt.filter("full > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("pass"))

    in_block = _digest("_source.name", "block", "pass", seed)
    part = dealt.filter("passes > full").withColumn("pass", F.col("full"))
    sums = part.groupBy("_source", "block", "pass").agg(F.sum("tokens").alias("n"), F.max((F.col("passes") - F.col("full")) * F.col("all_tokens")).alias("left"))
    sums = running(sums, ["_source"], hex_bucket(in_block), [in_block, "block"], F.col("n")).withColumnRenamed("_before", "before")
    taken = sums.filter("before < left").withColumn("fits", F.col("before") + F.col("n") <= F.col("left")).select("_source", "block", "before", "left", "fits")
    some = part.join(taken, ["_source", "block"])
    in_row = _digest("_row", "pass", seed)
    inside = Window.partitionBy("_source", "block").orderBy(in_row, "_row").rowsBetween(Window.unboundedPreceding, -1)  # one block of a source
    cut = some.filter("NOT fits").withColumn("seen", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    last = some.filter("fits").select(*dealt.columns, "pass").unionAll(cut.filter("seen < left").select(*dealt.columns, "pass"))

    place = (F.col("pass") + (F.floor(_uniform(in_block) * F.col("blocks")) + _uniform(in_row)) / F.col("blocks")) / F.col("passes")
    return whole.unionAll(last).select("_row", "source", "tokens", "pass", F.round(F.least(place, F.lit(1.0)), 9).alias("place"))


def mix_rows(rows: DataFrame, seed: int = SEED, **limits) -> tuple[DataFrame, DataFrame]:
    """What is taken of ``rows`` (_row, source, tokens), and the weights of the sources; ``limits`` as in ``source_weights``."""
    totals = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    weights = materialize(source_weights(totals, **limits), "weights")
    return realise(rows, weights, seed), weights


def mix(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with each row as often as its source's weight has it; same columns."""
    row, times, time = (free_name(docs, n) for n in ("_row", "_times", "_time"))
    rows = keyed(docs, row=row)
    taken, _ = mix_rows(rows.select(F.col(row).alias("_row"), F.col("source").cast("string").alias("source"), words_count(F.col("text")).alias("tokens")), **limits)
    counts = taken.groupBy(F.col("_row").alias(row)).agg(F.count("*").cast("int").alias(times))
    return rows.join(counts, row).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns_of(docs))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time that a document is taken, with its source's weight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = keyed(docs)
    slim = materialize(rows.select("_row", "doc_id", "source", words_count(F.col("text")).alias("tokens")), "token-counts")
    taken, weights = mix_rows(slim.select("_row", "source", "tokens"))
    w = weights.select(F.col("source").alias("_s"), "exponent", "bound", F.round("weight", 9).alias("weight"), "passes")
    named = taken.join(slim.select("_row", "doc_id"), "_row")
    met = named.join(w, F.col("source").eqNullSafe(F.col("_s")))
    return met.select("doc_id", "source", "tokens", F.col("pass").cast("int").alias("pass"), "place", "weight", "exponent", "bound", "passes")


def _uniform_sql(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT * pow(2::DOUBLE, -52))"


_ENTROPY = "ln(list_sum(list_transform(q, lambda x: pow(x, {a})))) - {a} * list_sum(list_transform(q, lambda x: pow(x, {a}) * ln(x))) / list_sum(list_transform(q, lambda x: pow(x, {a})))"
_IN_BLOCK = f"md5(concat_ws('|', coalesce(source, ''), block, pass, {SEED}))"
_IN_ROW = f"md5(concat_ws('|', doc_id, pass, {SEED}))"
OP9_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM t GROUP BY 1),
top AS (SELECT max(tokens)::DOUBLE AS top FROM s),
l AS (SELECT list(tokens / top) AS q, count(*) AS n FROM s, top WHERE tokens > 0),
w AS (SELECT q, h + {FLATTEN}::DOUBLE * (ln(n) - h) AS want FROM (SELECT *, {_ENTROPY.format(a="1")} AS h FROM l)),
b AS (SELECT 0 AS k, 0::DOUBLE AS low, 1::DOUBLE AS high UNION ALL
  SELECT k + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT k, low, high, mid, {_ENTROPY.format(a="mid")} <= want AS fits FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE k < {AT_ONCE * PASSES}), w)),
e AS (SELECT round(greatest(high, least_), 9) AS exponent, CASE WHEN high < least_ THEN 'repeats' ELSE 'entropy' END AS bound
  FROM b, (SELECT 1 - ln({MAX_REPEATS}::DOUBLE) / ln(1 / list_min(q)) AS least_ FROM l) WHERE k = {AT_ONCE * PASSES}),
p AS (SELECT source, tokens AS all_tokens, exponent, bound, CASE WHEN tokens > 0 THEN pow(tokens / top, exponent) / total ELSE 0 END AS weight,
  CASE WHEN tokens > 0 THEN round(pow(tokens / top, exponent - 1), 9) ELSE 1.0::DOUBLE END AS passes, greatest(1, ceil(docs / {BLOCK}::DOUBLE))::BIGINT AS blocks FROM s, top, e, (SELECT list_sum(list_transform(q, lambda x: pow(x, exponent))) AS total FROM l, e)),
d AS (SELECT t.doc_id, t.source, t.tokens, p.* EXCLUDE (source), floor(passes)::INTEGER AS whole, ('0x' || substr(md5(concat_ws('|', doc_id, {SEED})), 1, 13))::BIGINT % blocks AS block
  FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source),
f AS (SELECT * FROM (SELECT d.*, unnest(generate_series(0, whole - 1))::INTEGER AS pass FROM d WHERE whole > 0)),
r AS (SELECT *, whole AS pass FROM d WHERE passes > whole),
u AS (SELECT source, block, pass, sum(tokens) AS n, max((passes - whole) * all_tokens) AS left_ FROM r GROUP BY ALL),
v AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY {_IN_BLOCK}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
x AS (SELECT r.*, before, left_, before + n <= left_ AS fits FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source AND r.block = v.block WHERE before < left_),
y AS (SELECT *, before + coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY {_IN_ROW}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM x),
z AS (SELECT * FROM f UNION ALL SELECT * EXCLUDE (before, left_, fits, seen) FROM y WHERE fits OR seen < left_)
SELECT doc_id, source, tokens, pass, round(least(1, (pass + (floor({_uniform_sql(_IN_BLOCK)} * blocks) + {_uniform_sql(_IN_ROW)}) / blocks) / passes), 9) AS place, round(weight, 9) AS weight, exponent, bound, passes FROM z
"""
