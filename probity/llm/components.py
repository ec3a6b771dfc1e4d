"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node of its component.

    Every step replaces a node's links by links to its smallest neighbour; minima are pre-aggregated, so a hub never
    gathers its neighbours. Rounds are logarithmic in practice; each is a written table; the last is known by every node having one link
    and no root any. Loops (a = b) are ignored; no null is expected; without links there are no nodes.
    """
    cur = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc0")
    for k in range(1, most_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = scratch.keep(large, f"cc{k}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        nxt = scratch.keep(small, f"cc{k}")
        scratch.drop(f"cc{k}l")
        if k > 1:
            scratch.drop(f"cc{k - 1}")
        cur = nxt
        ends = cur.select("u", F.lit(1).alias("own"), F.lit(0).alias("root")).unionByName(cur.select(F.col("v").alias("u"), F.lit(0).alias("own"), F.lit(1).alias("root")))
        if ends.groupBy("u").agg(F.sum("own").alias("own"), F.max("root").alias("root")).filter("own + root > 1").isEmpty():
            # every node has one link, to a root
            roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError("components did not settle")
