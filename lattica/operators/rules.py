"""Validation: rules as boolean columns, evaluated in one pass; issues and summaries as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check: ``valid`` is true for rows that pass; null counts as passing, as for absent elements."""

    key: str
    severity: str
    valid: Column
    message: str = ""


def required(column: str) -> Rule:
    return Rule(f"{column}-required", "error", F.col(column).isNotNull())


def cardinality(column: str, least: int, most: int | None) -> Rule:
    n = F.coalesce(F.size(column), F.lit(0))
    return Rule(f"{column}-cardinality", "error", (n >= least) & (n <= most if most is not None else F.lit(True)))


def fixed(column: str, value) -> Rule:
    return Rule(f"{column}-fixed", "error", F.col(column) == value)


def pattern(column: str, regex: str) -> Rule:
    return Rule(f"{column}-pattern", "error", F.col(column).rlike(regex))


def invariant(key: str, expression: str, severity: str = "error") -> Rule:
    return Rule(key, severity, F.expr(expression))


def slice_count(array: str, name: str, discriminator, least: int, most: int) -> Rule:
    n = F.size(F.filter(F.col(array), discriminator))
    return Rule(f"{array}:{name}", "error", (n >= least) & (n <= most))


def issues(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """One row for each failed rule: key, rule, severity, message."""
    failed = F.array(*[F.when(~F.coalesce(r.valid, F.lit(True)), F.struct(F.lit(r.key).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules])
    return rows.select(F.col(key).alias("id"), F.explode(F.array_compact(failed)).alias("i")).select("id", "i.*")


def binding(rows: DataFrame, key: str, column: str, expansion: DataFrame, strength: str = "required") -> DataFrame:
    """Issues for codes outside an expansion; severity by the strength of the binding."""
    severity = {"required": "error", "extensible": "warning", "preferred": "information"}[strength]
    out = rows.where(F.col(column).isNotNull()).join(expansion.select(F.col("code").alias(column)).distinct(), column, "left_anti")
    return out.select(F.col(key).alias("id"), F.lit(f"{column}-binding").alias("rule"), F.lit(severity).alias("severity"), F.lit("").alias("message"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("documents"))


# ---- profiles -----------------------------------------------------------------------------------


def merged_snapshot(base: DataFrame, differential: DataFrame) -> DataFrame:
    """Elements of a profile: base rows narrowed by the differential (path, min, max, types, binding).

    A differential may only restrict: the larger min, the smaller max, the types that both allow. Paths that only
    the differential has are added.
    """
    d = differential.select("path", *[F.col(c).alias(f"d_{c}") for c in ("min", "max", "types", "binding")])
    narrow = {
        "min": F.greatest("min", "d_min"), "max": F.least("max", "d_max"),
        "types": F.when(F.col("d_types").isNull() | F.col("types").isNull(), F.coalesce("d_types", "types")).otherwise(F.array_intersect("types", "d_types")), "binding": F.coalesce("d_binding", "binding")}
    return base.join(d, "path", "full_outer").select("path", *[v.alias(k) for k, v in narrow.items()])


def differential(base: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Elements of a snapshot that differ from the base, with null for what does not."""
    b = base.select("path", *[F.col(c).alias(f"b_{c}") for c in ("min", "max", "types", "binding")], F.lit(True).alias("known"))
    j = snapshot.join(b, "path", "left")
    cols = {c: F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), F.col(c)) for c in ("min", "max", "types", "binding")}
    changed = F.col("known").isNull()
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return j.where(changed).select("path", *[v.alias(k) for k, v in cols.items()])


def unknown_elements(rows: DataFrame, key: str, column: str, known: list[str]) -> DataFrame:
    """Issues for keys of JSON objects that a schema does not name."""
    found = rows.select(F.col(key).alias("id"), F.explode(F.json_object_keys(column)).alias("element")).where(~F.col("element").isin(known))
    return found.select("id", F.concat(F.col("element"), F.lit("-unknown")).alias("rule"), F.lit("error").alias("severity"), F.lit("").alias("message"))


def deep_snapshot(snapshots: DataFrame, path: str, depth: int) -> DataFrame:
    """Elements of a type with those of its elements' types below them, down to ``depth``. Rows: type, path, of (type of the element)."""
    out = snapshots.where(F.col("type") == path).select("path", "of")
    level = out
    for _ in range(depth):
        inner = snapshots.select(F.col("type").alias("of"), F.substring_index("path", ".", -1).alias("_last"), F.col("of").alias("_of"))
        level = level.join(inner, "of").select(F.concat_ws(".", "path", "_last").alias("path"), F.col("_of").alias("of"))
        out = out.unionByName(level)
    return out
