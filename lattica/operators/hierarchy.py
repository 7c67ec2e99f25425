"""Closures over parent edges: semi-naive iteration by doubling, with a check against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import cut


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", reflexive: bool = True) -> DataFrame:
    """(descendant, ancestor, distance): every pair once, at its least distance.

    Once all pairs up to a distance are known, a round joins those at just that distance with all, and drops
    pairs known, so the distance doubles and cycles end. Rounds go on until one finds nothing; they are
    checkpointed in the shared folder, which cuts the plan.
    """
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct()
    found = e.select(F.col("c").alias("descendant"), F.col("p").alias("ancestor"), F.lit(1).alias("distance"))
    known = 1
    while True:
        first = found.where(F.col("distance") == known).select("descendant", F.col("ancestor").alias("by"))
        then = found.select(F.col("descendant").alias("by"), "ancestor", (F.col("distance") + known).alias("distance"))
        after = first.join(then, "by").groupBy("descendant", "ancestor").agg(F.min("distance").alias("distance"))
        front = cut(after.join(found, ["descendant", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        known *= 2
    if not reflexive:
        return found
    nodes = e.select(F.col("c").alias("n")).unionByName(e.select(F.col("p").alias("n"))).distinct()
    own = nodes.select(F.col("n").alias("descendant"), F.col("n").alias("ancestor"), F.lit(0).alias("distance"))
    return own.unionByName(found.where("descendant <> ancestor"))


def below(tree: DataFrame, node: str) -> DataFrame:
    return tree.where(F.col("ancestor") == node).select(F.col("descendant").alias("node"))


def above(tree: DataFrame, node: str) -> DataFrame:
    return tree.where(F.col("descendant") == node).select(F.col("ancestor").alias("node"))


def around(tree: DataFrame, node: str) -> DataFrame:
    """Itself, its ancestors and its descendants."""
    return below(tree, node).unionByName(above(tree, node)).distinct()


def variant_descendants(docs: DataFrame, key: str, value: str) -> DataFrame:
    """(id, path, value) of all nodes below a VARIANT document, level by level until a level is empty; array items stand for their array."""
    spark = docs.sparkSession
    level = docs.select(F.col(key).alias("id"), F.lit("").alias("path"), F.col(value).alias("v"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        below_ = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        at = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), "key"))
        texts = cut(below_.select("id", at.alias("path"), F.to_json("value").alias("value")))
        if texts.isEmpty():
            return out
        level = texts.select("id", "path", F.parse_json("value").alias("v"))
        nodes = texts.where(~F.col("value").startswith("["))
        out = nodes if out is None else out.unionByName(nodes)
