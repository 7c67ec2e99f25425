"""Dates with stated precision, calendar durations, and quantities with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of calendar durations and the fields of an interval they stand for.
CALENDAR = {"year": "years", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def add_duration(ts: Column, n: Column | int, unit: str) -> Column:
    """A timestamp and a calendar duration; the last day of a month stays within its month."""
    field = CALENDAR[unit.removesuffix("s")]
    amount = F.lit(n) if isinstance(n, int) else n
    return ts + F.make_interval(**{field: amount})


def low_date(x: Column) -> Column:
    """The first instant that a partial date (text) allows."""
    return F.concat(x, F.when(F.length(x) == 4, "-01-01").when(F.length(x) == 7, "-01").otherwise("")).try_cast("timestamp_ntz")


def high_date(x: Column) -> Column:
    """The last day that a partial date (text) allows."""
    low = low_date(x).cast("date")
    return F.when(F.length(x) == 4, F.make_date(F.year(low), F.lit(12), F.lit(31))).when(F.length(x) == 7, F.last_day(low)).otherwise(low)


def comparable(a: Column, b: Column) -> Column:
    """Do two partial dates have the same precision?"""
    return F.length(a) == F.length(b)


def age_at(birth: Column, at: Column) -> Column:
    """Completed years."""
    return F.floor(F.months_between(at, birth) / 12).cast("int")


def born_between(at: Column, years: int) -> tuple[Column, Column]:
    """Birth dates (after, up to) of people who are ``years`` old at an instant."""
    day = at.cast("date")
    return F.add_months(day, -12 * (years + 1)), F.add_months(day, -12 * years)


def quantity(value: Column, unit: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), unit.alias("unit"))


def add_quantities(a: Column, b: Column, factors: dict[str, float]) -> Column:
    """The sum in the finer unit; nothing if a unit is unknown. ``factors`` maps units of one dimension to its base."""
    table = F.create_map(*[F.lit(x) for k, v in factors.items() for x in (k, float(v))])
    fa, fb = F.try_element_at(table, a["unit"]), F.try_element_at(table, b["unit"])
    unit = F.when(fa <= fb, a["unit"]).otherwise(b["unit"])
    total = (a["value"] * fa + b["value"] * fb) / F.least(fa, fb)
    return F.when(fa.isNotNull() & fb.isNotNull(), F.struct(total.alias("value"), unit.alias("unit")))
