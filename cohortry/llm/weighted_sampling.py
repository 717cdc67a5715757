"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts.  For each of ``SAMPLES`` samples, each term
draws, from a hash of the term and the sample's number alone, r and c from the gamma
distribution of shape 2 and b from 0 to 1.  With weight w it gets t = floor(ln w / r + b) and
the key ln c - r (t - b + 1); the term with the least key is the sample, together with its t.
Two texts have equal samples with a probability that is their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater.

Texts are shuffled once, by row, into parts of bounded size; exploding words, counting them and
taking the least keys all happen on that partitioning, so words are never shuffled.  Key and
sample are packed into one long, which a plain minimum combines.  DataFrame functions only.

Defined results: null, empty and blank texts have one term of their own, and equal
fingerprints; likeness is the share of equal samples; repeated rows and ids are rows of their
own, in the order of ``_row``; one row is its own next; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import keyed, materialize, parts_for

#: Samples of a fingerprint, those that one exploded row computes, bits of a sample.
SAMPLES, AT_ONCE, SAMPLE_BITS = 64, 4, 25
#: Code points of text that a task holds, and row numbers that a range holds, on average.
CHARS_PER_PART, ROWS_PER_RANGE = 4_000_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(bits: Column, shift: int) -> Column:
    """A number within 0 and 1 from 21 of the bits."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0x1FFFFF)) + F.lit(0.5)) * F.lit(2.0**-21)


def _packed(term: Column, log_weight: Column, r: Column, b: Column, log_c: Column) -> Column:
    """The key, scaled to whole numbers, above the bits that name the term and its t; null if absent."""
    t = F.floor(log_weight / r + b)
    key = log_c - r * (t - b + 1)
    name = term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(2**SAMPLE_BITS - 1))
    return F.shiftleft(((key + 64) * F.lit(2.0**31)).cast("long"), SAMPLE_BITS).bitwiseOR(name)


def least_keys(terms: DataFrame, weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """(_row, s_<weight>...) with the samples of each weight column as an array of longs.

    ``terms`` has one row (_row, term, weights...) per row and term; a null weight means that
    the term is absent there.
    """
    groups = F.explode(F.array(*[F.lit(g) for g in range(0, samples, AT_ONCE)]))
    logs = terms.select("_row", "term", *[F.ln(F.col(w).cast("double")).alias(w) for w in weights])
    rows = logs.select("*", groups.alias("g"))
    drawn = ["_row", "g", "term", *weights]
    for k in range(AT_ONCE):
        x = F.xxhash64("term", F.col("g") + F.lit(k))
        rows = rows.withColumn(f"x{k}", x).withColumn(f"y{k}", F.xxhash64(f"x{k}", F.lit(1)))
        r = -F.ln(_uniform(F.col(f"x{k}"), 0) * _uniform(F.col(f"x{k}"), 21))
        log_c = F.ln(-F.ln(_uniform(F.col(f"y{k}"), 0) * _uniform(F.col(f"y{k}"), 21)))
        drawn += [r.alias(f"r{k}"), _uniform(F.col(f"x{k}"), 42).alias(f"b{k}"), log_c.alias(f"c{k}")]
    rows = rows.select(*drawn)
    least = [F.min(_packed(F.col("term"), F.col(w), F.col(f"r{k}"), F.col(f"b{k}"), F.col(f"c{k}"))).alias(f"{w}{k}") for w in weights for k in range(AT_ONCE)]
    groups = rows.groupBy("_row", "g").agg(*least)
    names = [F.array(*[F.col(f"{w}{k}").bitwiseAND(F.lit(2**SAMPLE_BITS - 1)) for k in range(AT_ONCE)]).alias(w) for w in weights]
    listed = groups.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("g", *names))).alias("all"))  # samples / AT_ONCE entries
    # The field of an array of structs is the array of the field.
    return listed.select("_row", *[F.flatten(F.col(f"all.{w}")).alias(f"s_{w}") for w in weights])


def words_of(text: Column) -> Column:
    """The words of a text; one null for a text without any."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(F.size(words) == 0, F.array(F.lit(None).cast("string"))).otherwise(words)


def fingerprint_columns(rows: DataFrame, texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """(_row, s_<text>...) for text columns of ``rows``, which is partitioned by ``_row``."""
    each = F.explode(F.array(*[F.struct(words_of(F.col(t)).alias("words"), *[F.lit(int(t == u)).alias(u) for u in texts]) for t in texts]))
    words = rows.select("_row", each.alias("x")).select("_row", *[F.col(f"x.{t}").alias(t) for t in texts], F.explode("x.words").alias("word"))
    hashed = words.select("_row", F.xxhash64("word").alias("term"), *texts)
    counts = hashed.groupBy("_row", "term").agg(*[F.nullif(F.sum(t), F.lit(0)).alias(t) for t in texts])
    return least_keys(counts, texts, samples)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return equal / F.size(a)


def as_text(samples: Column) -> Column:
    """A fingerprint as hexadecimal digits, seven a sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 7, "0")), "")


def next_rows(rows: DataFrame, parts: int) -> DataFrame:
    """(_row, n_chars, next_row) in ascending order of ``_row``, the first after the last.

    Rows are dealt by range, each range finds its own successions, and what ends a range is
    followed by the first row of the next one.
    """
    ranged = rows.repartitionByRange(parts, "_row").withColumn("p", F.spark_partition_id())
    dealt = materialize(ranged, "ranges")
    inside = dealt.withColumn("after", F.lead("_row").over(Window.partitionBy("p").orderBy("_row")))
    firsts = dealt.groupBy("p").agg(F.min("_row").alias("first"))  # one row a range
    w = Window.orderBy("p")
    follow = firsts.select("p", F.coalesce(F.lead("first").over(w), F.first("first").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("next_first"))
    return inside.join(follow, "p").select("_row", "n_chars", F.coalesce("after", "next_first").alias("next_row"))


def fingerprints_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and the likenesses.

    ``docs`` carries ``_row``.  The edited form has the first code points of the next text in
    place of the last quarter, rounded down.
    """
    base = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lengths = materialize(base.select("_row", "doc_id", F.char_length("text").cast("long").alias("n_chars")), "lengths")
    total, n_rows = lengths.agg(F.coalesce(F.sum("n_chars"), F.lit(0)), F.count("*")).first()
    parts = parts_for(docs, total, CHARS_PER_PART)
    links = materialize(next_rows(lengths.select("_row", "n_chars"), parts_for(docs, n_rows, ROWS_PER_RANGE)), "links")

    texts = base.select("_row", "text").repartition(parts, "_row")
    asked = links.select(F.col("next_row").alias("_row"), F.col("_row").alias("asker"), F.floor(F.col("n_chars") / 4).cast("int").alias("m"))
    heads = texts.join(asked, "_row").select(F.col("asker").alias("_row"), "m", F.substring(F.col("text"), F.lit(1), F.col("m")).alias("head"))
    heads = heads.repartition(parts, "_row")
    length = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - F.col("m")), "head")
    both = texts.join(heads.hint("shuffle_merge"), "_row").select("_row", "text", edited.alias("edited"))

    hashes = F.sha2("edited", 256)
    marked = both.select("_row", hashes.alias("edited_sha256"), "text", "edited")
    signed = fingerprint_columns(marked, ["text", "edited"], samples)
    found = materialize(marked.select("_row", "edited_sha256").join(signed, "_row"), "signatures")

    rows = lengths.join(links.select("_row", "next_row"), "_row").join(found, "_row")
    after = found.select(F.col("_row").alias("next_row"), F.col("s_text").alias("s_next"))
    return rows.join(after, "next_row")


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fingerprints_with_edits(keyed(docs))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("s_text")).alias("fingerprint"),
        as_text(F.col("s_edited")).alias("edited_fingerprint"),
        likeness(F.col("s_text"), F.col("s_edited")).alias("near_edited"),
        likeness(F.col("s_text"), F.col("s_next")).alias("near_next"),
    )
