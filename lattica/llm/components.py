"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, materialize, spread_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can reach.

    Every round joins each node with the least of its neighbours and writes the new edges to the
    shared folder; the rounds needed grow with the logarithm of the longest path. Minima are
    pre-aggregated in each task, and the minima of nodes with very many edges are broadcast.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = materialize(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    sign, n = None, F.count(F.lit(1))
    rows = now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), n.alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, "u", "n", 2 * rows).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), n.alias("n"))
        small = spread_join(large, least, "u", "n", 2 * rows).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(now, large)
        now = after
        at = now.agg(n, F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        rows = at[0]
        if at == sign:
            break
        sign = at
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
