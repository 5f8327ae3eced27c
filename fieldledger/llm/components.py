"""Connected components of large graphs: every node gets the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to the smallest node in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of `edges` (a, b long). Each turn is written to the shared folder; the number of
    turns grows with the logarithm of the longest path. Edges of a hot node are aggregated before they are shuffled, and
    the joins can be split by skew."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        now = saved(_small_star(_large_star(now)), "edges")
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
