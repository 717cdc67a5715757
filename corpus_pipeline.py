"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents;
the last returns the places of token pieces in sequences.

Defined results, in every stage: a null text counts as empty; texts of any length are used
whole; rows that repeat an id, or have none, are rows of their own, in order of their id, the
null ones last; further columns, of any name, are kept to the last stage; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import exact_dedup, mixing, packing, quality_rules, simhash
from cohortry.llm.common import Scratch, materialize

#: How often the mix repeats a source at most; the largest source comes once.
MAX_REPEATS = 2.0
#: Jaccard similarity of five-word shingles from which two documents are near-duplicates.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores under a half go; a score of a half stays, and without labels all do."""
    return quality_rules.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are equal but for white space the row with the smallest id stays; empty and null texts are one group."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, by fingerprint or by five-word shingles, the document with the smallest id stays; texts without words are one class."""
    return simhash.deduplicate(docs, similarity=SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come at their target weights: every document once, those of small sources more often; a null source is one."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each token piece in sequences of 2048 tokens; an empty text is a piece of its end id."""
    return packing.digest(*packing.pack_documents(docs))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next.

    What a stage wrote for itself is deleted once its result is written, and that once the next
    stage has been.  The last stage's tables stay, since its result reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *early, (_, last) = STAGES
    with Scratch(spark) as results:
        for k, (_, stage) in enumerate(early):
            with Scratch(spark) as own:
                after = own.keep(materialize(stage(spark, docs, sf_dir), f"stage-{k}"))
            results.drop_all_but(after)
            docs = after
        results.keep(docs)
    return last(spark, docs, sf_dir)


#: Tokenisation and the fitted classifier can't be expressed in SQL.
ORACLE_SQL = None
