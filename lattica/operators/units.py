"""Quantities with units: conversion and comparison through a small table of factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit, dimension, factor to the dimension's base unit, offset.
UNITS = [
    ("kg", "mass", 1e3, 0.0), ("g", "mass", 1.0, 0.0), ("mg", "mass", 1e-3, 0.0), ("ug", "mass", 1e-6, 0.0), ("[lb_av]", "mass", 453.59237, 0.0), ("[oz_av]", "mass", 28.349523125, 0.0),
    ("km", "length", 1e3, 0.0), ("m", "length", 1.0, 0.0), ("cm", "length", 1e-2, 0.0), ("mm", "length", 1e-3, 0.0), ("[in_i]", "length", 0.0254, 0.0), ("[ft_i]", "length", 0.3048, 0.0),
    ("L", "volume", 1.0, 0.0), ("dL", "volume", 0.1, 0.0), ("mL", "volume", 1e-3, 0.0),
    ("a", "time", 31557600.0, 0.0), ("wk", "time", 604800.0, 0.0), ("d", "time", 86400.0, 0.0), ("h", "time", 3600.0, 0.0), ("min", "time", 60.0, 0.0), ("s", "time", 1.0, 0.0), ("ms", "time", 1e-3, 0.0),
    ("K", "temperature", 1.0, 0.0), ("Cel", "temperature", 1.0, 273.15), ("[degF]", "temperature", 5 / 9, 255.3722222222222),
    ("%", "ratio", 1e-2, 0.0), ("1", "ratio", 1.0, 0.0),
]


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "unit string, dimension string, factor double, offset double")


def normalized(rows: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """``rows`` with dimension and base_value; null for unknown units. The table is a few dozen rows: broadcast."""
    u = units(rows.sparkSession).withColumnRenamed("unit", "_unit")
    return rows.join(F.broadcast(u), F.col(unit) == F.col("_unit"), "left").withColumn("base_value", F.col(value) * F.col("factor") + F.col("offset")).drop("_unit", "factor", "offset")


def converted(rows: DataFrame, to: str, value: str = "value", unit: str = "unit") -> DataFrame:
    """``rows`` with ``converted``: the value in another unit of the same dimension, else null."""
    dimension, factor, offset = next((d, f, o) for u, d, f, o in UNITS if u == to)
    return normalized(rows, value, unit).withColumn("converted", F.when(F.col("dimension") == dimension, (F.col("base_value") - offset) / factor))


def comparable_with(rows: DataFrame, value: float, unit: str, op: str = ">=") -> DataFrame:
    """Rows whose quantity compares with a literal of any unit of the same dimension."""
    dimension, factor, offset = next((d, f, o) for u, d, f, o in UNITS if u == unit)
    base = value * factor + offset
    b = F.col("base_value")
    test = {">=": b >= base, ">": b > base, "<=": b <= base, "<": b < base, "=": b == base}[op]
    return normalized(rows).where((F.col("dimension") == dimension) & test)


def equivalent(a: str, b: str) -> bool:
    """Do two units have one dimension, and neither an offset?"""
    known = {u: (d, o) for u, d, _, o in UNITS}
    return a in known and b in known and known[a][0] == known[b][0] and not known[a][1] and not known[b][1]


def convertible(rows: DataFrame, to: str, unit: str = "unit") -> DataFrame:
    """``rows`` with ``convertible``: the unit has the dimension of ``to``."""
    dimension = next(d for u, d, _, _ in UNITS if u == to)
    return normalized(rows.withColumn("_one", F.lit(1.0)), "_one", unit).withColumn("convertible", F.coalesce(F.col("dimension") == dimension, F.lit(False))).drop("_one", "dimension", "base_value")
