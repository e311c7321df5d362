"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.sources.scratch import dropped, materialised


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): for each u the least of itself and its v's."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any order. (node, component): the least node that each node reaches.

    Alternates two steps until nothing changes: every node hands its least neighbour to its larger
    neighbours, then to its smaller ones. Each round shortens all paths, so rounds grow with the logarithm of the longest
    one. A node with very many neighbours is counted map-side, and its join is split by AQE.
    """
    now = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u", F.lit(1)) % 1_000_033)).first()
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every u is larger than its v's here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now, old = materialised(small.filter("u <> v").distinct()), now
        dropped(old)
