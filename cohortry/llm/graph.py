"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, materialize


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set, to see whether a round changed it."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def _round(now: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    with Scratch(now.sparkSession) as block:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return block.keep(materialize(rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with a path to a smaller one; component is the smallest.

    A component's smallest node isn't listed, nor are nodes without edges: they are their own.

    ``edges`` has long columns src and dst.  Rounds of large-star and small-star: each links
    a node's neighbours to the smallest of them, until nothing changes, which takes a number of
    rounds of the order of the squared logarithm of the nodes.  A round's edges are written to
    the shared folder and those of the round before deleted, so lineage stays short and a lost
    executor costs one round.  The joins are plain sort-merge joins on the node, which AQE splits
    where a hub is hot.
    """
    u, v = F.greatest("src", "dst"), F.least("src", "dst")
    now = materialize(edges.filter("src <> dst").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state, before = _state(now), None
    while state != before:
        with Scratch(now.sparkSession) as block:
            block.paths.append(now._written)  # read for the last time
            after = block.keep(_round(now))
        now, before, state = after, state, _state(after)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
