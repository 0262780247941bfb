"""Connected components by alternating large and small stars; only edges of the graph are ever shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import Scratch, cut


def _large(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours moved to the least of its neighbourhood; the minima are a table to be dropped."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return scratch.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), least


def _small(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours moved to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = scratch.cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return scratch.cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), least


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, for the nodes of ``edges`` (columns u and v) but the smallest.

    The steps end when neither changes an edge, after about the logarithm of the longest chain; each is written to the
    shared folder, and the tables of the step before are deleted. Repeated edges and loops do no harm, and no edges give
    no rows. A node with very many neighbours is one side of a join that can be split (the minima are written for that),
    never a group in one task.
    """
    scratch = Scratch(edges.sparkSession)
    stars = scratch.cut(edges.select("u", "v").where("u != v").distinct())
    before = None
    while True:
        large, least = _large(stars, scratch)
        scratch.drop(stars, least)
        stars, least = _small(large, scratch)
        scratch.drop(large, least)
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
        if (state["n"], state["s"]) == before:
            found = cut(stars.select(F.col("u").alias("node"), F.col("v").alias("component")))
            scratch.close()
            return found
        before = (state["n"], state["s"])
