"""Site-relative boilerplate lines.

Within a host, the share of its pages that contain a line tells boilerplate from text: lines
on more than ``max_ratio`` of the pages of a host with at least ``min_pages`` pages go.  By default
hosts of fewer than five pages are left alone: of theirs, each line that one page has would be over the ratio.

A page adds each of its lines once; lines are counted as 128-bit digests with map-side
combination, so what is shuffled is one row per host, line and map task, however hot a host
is.  A host has at most (lines per page) / ``max_ratio`` such lines, so they go to its pages as
one array, by a salted join, and each page looks its lines up in them as a set.

Defined results: a null page has no lines; a null url is a host of its own (null); what follows
an unclosed comment, script or style is no text, and an unclosed tag is text; broken or very
long pages take time linear in them; ratios equal to the limit stay; a line that recurs within a
page counts once and stays or goes as often as it is there; repeated rows count as pages of
their own; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import attach, materialize

MAX_RATIO, MIN_PAGES = 0.3, 5
#: What is no text, what ends a line, and other markup.  Fixed patterns.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|title|table|tr|td|br|head|body|html)([^A-Za-z0-9>][^>]*)?>"
TAGS = r"<[^>]*>"
#: Put at a page's end, so that what isn't closed is read once.
CLOSING = "--></script></style>"


def host_of(url):
    """Host of a url, in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_lines(html):
    """Lines of text of a page, trimmed, none blank, in order."""

    def without_closing(shown: Column) -> Column:
        return F.when(F.endswith(shown, F.lit(CLOSING)), F.left(shown, F.char_length(shown) - len(CLOSING))).otherwise(shown)

    def text(shown: Column) -> Column:
        tail = F.substring_index(shown, ">", -1)  # has no whole tag, and would be searched from each of its <
        head = F.left(shown, F.char_length(shown) - F.char_length(tail))
        return F.concat(F.regexp_replace(F.regexp_replace(head, BREAKS, "\n"), TAGS, ""), tail)

    hidden = F.regexp_replace(F.concat(F.coalesce(html, F.lit("")), F.lit(CLOSING)), HIDDEN, "")
    lines = F.split(_let(_let(hidden, without_closing), text), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop) with the digests of each host's boilerplate; ``pages`` has host and lines."""
    host = F.coalesce("host", F.lit(""))  # groups null hosts and joins them
    own = pages.select(host.alias("host"), F.array_distinct(F.transform("lines", lambda x: F.md5(x))).alias("digests"))
    totals = own.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    counts = own.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    # A line over the limit of the smallest host that counts; most lines are not.
    often = counts.filter(F.col("n") > F.lit(max_ratio * min_pages)).join(totals, "host").filter(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("digest").alias("drop"))


def drop_boilerplate(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text): the lines of each page that are its own."""
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), text_lines(F.col(html)).alias("lines"))
    rows = materialize(rows, "lines")  # read again to count and to drop; markup is parsed once
    found = boilerplate(rows, max_ratio, min_pages)
    with_key = rows.withColumn("_host", F.coalesce("host", F.lit("")))
    joined = attach(with_key, found.withColumnRenamed("host", "_host"), ["_host"], "page_id", "left")
    own = T.StructType([joined.schema["page_id"], *(T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in ("host", "n_lines", "n_dropped", "text"))])
    return joined.select("page_id", "host", "lines", "drop").mapInArrow(_drop, own)


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, dropped, texts = [], [], []
        for lines, drop in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            gone = set(drop or ())
            kept = [x for x in lines if md5(x.encode()).hexdigest() not in gone] if gone else lines
            counts.append(len(lines))
            dropped.append(len(lines) - len(kept))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=["page_id", "host", "n_lines", "n_dropped", "text"]
        )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page without its host's boilerplate."""
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP1_SQL = f"""
WITH l AS (
  SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(CASE WHEN suffix(shown, '{CLOSING}') THEN left(shown, length(shown) - {len(CLOSING)}) ELSE shown END,
           '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM (SELECT *, regexp_replace(coalesce(html, '') || '{CLOSING}', '{HIDDEN}', '', 'g') AS shown FROM pages)
), t AS (SELECT host, count(*) AS pages FROM l GROUP BY host HAVING count(*) >= {MIN_PAGES}),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL),
b AS (SELECT c.host, list(line) AS dropped FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n > {MAX_RATIO} * pages GROUP BY ALL),
j AS (SELECT l.*, coalesce(list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)), []) AS kept
      FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text FROM j
"""
