"""Code systems, value sets and concept maps as tables: expand, look up, validate, subsume, translate.

Concepts: system, code, display, parent, active. Value set rows: include or exclude of a system, a code,
or a filter (is-a, descendent-of, = on a property). Maps: source and target codes with an equivalence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = ["system", "code"]


def included(concepts: DataFrame, tree: DataFrame, rule: dict) -> DataFrame:
    """The concepts of one rule: {system, codes?, is_a?, descendent_of?, property?: {name: values}, where?}."""
    c = concepts.where(F.col("system") == rule["system"])
    if "codes" in rule:
        c = c.where(F.col("code").isin(rule["codes"]))
    for op, least in (("is_a", 0), ("descendent_of", 1)):
        if op in rule:
            under = tree.where((F.col("ancestor") == rule[op]) & (F.col("distance") >= least)).select(F.col("descendant").alias("code"))
            c = c.join(under, "code", "left_semi")
    for name, values in rule.get("property", {}).items():
        c = c.where(_has_property(name, values))
    return c.where(rule["where"]) if "where" in rule else c


def _has_property(name: str, values: list[str]):
    return F.exists("properties", lambda p: (p["code"] == name) & p["value"].isin(*values))


def composed(sets: dict[str, list[dict]], name: str, seen: tuple[str, ...] = ()) -> list[dict]:
    """The rules of a value set with those of the sets that it includes; a set that includes itself adds nothing."""
    if name in seen:
        return []
    out = []
    for rule in sets[name]:
        out += composed(sets, rule["value_set"], (*seen, name)) if "value_set" in rule else [rule]
    return out


def expand(concepts: DataFrame, tree: DataFrame, include: list[dict], exclude: list[dict] = (), active_only: bool = False, text: str = "", offset: int = 0, count: int | None = None) -> DataFrame:
    """A value set's concepts, ordered by system and code."""
    out = reduce(DataFrame.unionByName, [included(concepts, tree, r) for r in include]).dropDuplicates(CODE)
    for r in exclude:
        out = out.join(included(concepts, tree, r).select(*CODE), CODE, "left_anti")
    if active_only:
        out = out.where("active")
    if text:
        out = out.where(F.lower("display").contains(text.lower()))
    if offset or count is not None:
        out = out.orderBy(*CODE).offset(offset)
        out = out.limit(count) if count is not None else out
    return out


def lookup(concepts: DataFrame, properties: DataFrame, system: str, code: str) -> DataFrame:
    """A concept with its properties; a row without property if it has none."""
    return concepts.where((F.col("system") == system) & (F.col("code") == code)).join(properties, CODE, "left")


def lookup_all(concepts: DataFrame, properties: DataFrame, designations: DataFrame, system: str, code: str) -> DataFrame:
    """A concept with its properties and designations, a row for each: kind, name, value."""
    one = concepts.where((F.col("system") == system) & (F.col("code") == code)).select(*CODE, "display")
    p = one.join(properties, CODE).select(*CODE, "display", F.lit("property").alias("kind"), F.col("property").alias("name"), "value")
    d = one.join(designations, CODE).select(*CODE, "display", F.lit("designation").alias("kind"), F.col("language").alias("name"), "value")
    return p.unionByName(d)


def summary(concepts: DataFrame) -> DataFrame:
    """Concepts of each system: all and active ones."""
    return concepts.groupBy("system").agg(F.count(F.lit(1)).alias("concepts"), F.count_if("active").alias("active"))


def validate(codes: DataFrame, expansion: DataFrame) -> DataFrame:
    """``codes`` with ``valid``: the expansion holds the code."""
    have = expansion.select(*CODE).distinct().withColumn("valid", F.lit(True))
    return codes.join(have, CODE, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def subsumes(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with outcome: equivalent, subsumes, subsumed-by or not-subsumed."""
    down = tree.where("distance > 0").select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), F.lit(True).alias("down"))
    up = down.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("up"))
    outcome = F.when(F.col("a") == F.col("b"), "equivalent").when(F.col("down"), "subsumes").when(F.col("up"), "subsumed-by").otherwise("not-subsumed")
    return pairs.join(down, ["a", "b"], "left").join(up, ["a", "b"], "left").withColumn("outcome", outcome).drop("down", "up")


def translate(codes: DataFrame, mapping: DataFrame, reverse: bool = False) -> DataFrame:
    """Target codes of each code; ``matched`` unless the equivalence says unmatched or disjoint."""
    a, b = ("target", "source") if reverse else ("source", "target")
    m = mapping.select(F.col(f"{a}_system").alias("system"), F.col(f"{a}_code").alias("code"), F.col(f"{b}_system").alias("to_system"), F.col(f"{b}_code").alias("to_code"), "equivalence")
    return codes.join(m, CODE, "left").withColumn("matched", F.coalesce(~F.col("equivalence").isin("unmatched", "disjoint"), F.lit(False)))


def closure_table(tree: DataFrame, codes: DataFrame, version: int) -> DataFrame:
    """Subsumption pairs among a set of codes, stamped with a version."""
    own = codes.select("code").distinct()
    pairs = tree.where("distance > 0").join(own.withColumnRenamed("code", "descendant"), "descendant", "left_semi").join(own.withColumnRenamed("code", "ancestor"), "ancestor", "left_semi")
    return pairs.select("descendant", "ancestor", F.lit(version).alias("version"))
