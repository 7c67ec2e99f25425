"""Path functions on collections: array columns without null elements, where an empty array is 'nothing'.

Each function takes and returns Columns; they compose to ordinary expressions that Catalyst sees whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lift(x: Column) -> Column:
    """A collection of one value; nothing for null."""
    return F.filter(F.array(x), lambda v: v.isNotNull())


def one(c: Column) -> Column:
    """The value of a collection of one, else null."""
    return F.when(F.size(c) == 1, F.get(c, F.lit(0)))


def single(c: Column) -> Column:
    """The collection itself; an error if it holds more than one value."""
    return F.when(F.assert_true(F.size(c) <= 1, "single() on more than one value").isNull(), c)


def where(c: Column, p: Callable[[Column], Column]) -> Column:
    return F.filter(c, lambda x: F.coalesce(p(x), F.lit(False)))


def select(c: Column, e: Callable[[Column], Column]) -> Column:
    """Flat map: ``e`` gives a collection for each value."""
    return F.flatten(F.transform(c, e))


def aggregate(c: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(c, start, step)


def exists(c: Column, p: Callable[[Column], Column] | None = None) -> Column:
    return F.size(c) > 0 if p is None else F.coalesce(F.exists(c, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(False))


def all_(c: Column, p: Callable[[Column], Column]) -> Column:
    return F.forall(c, lambda x: F.coalesce(p(x), F.lit(False)))


def iif(test: Column, then: Column, otherwise: Column) -> Column:
    return F.when(test, then).otherwise(otherwise)


def empty(c: Column) -> Column:
    return F.size(c) == 0


def all_true(c: Column) -> Column:
    return F.forall(c, lambda x: x)


def any_true(c: Column) -> Column:
    return F.exists(c, lambda x: x)


def all_false(c: Column) -> Column:
    return F.forall(c, lambda x: ~x)


def any_false(c: Column) -> Column:
    return F.exists(c, lambda x: ~x)


def subset_of(c: Column, o: Column) -> Column:
    return F.size(F.array_except(c, o)) == 0


def superset_of(c: Column, o: Column) -> Column:
    return subset_of(o, c)


def count(c: Column) -> Column:
    return F.size(c)


def distinct(c: Column) -> Column:
    return F.array_distinct(c)


def is_distinct(c: Column) -> Column:
    return F.size(c) == F.size(F.array_distinct(c))


def first(c: Column) -> Column:
    return F.slice(c, 1, 1)


def last(c: Column) -> Column:
    return F.slice(c, -1, 1)


def tail(c: Column) -> Column:
    return F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(0)))


def skip(c: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("skip() of a negative number")
    return F.slice(c, F.lit(n + 1), F.greatest(F.size(c), F.lit(0)))


def take(c: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("take() of a negative number")
    return F.slice(c, 1, n)


def at(c: Column, i: int) -> Column:
    """``c[i]``, from 0; nothing beyond the end."""
    return F.slice(c, i + 1, 1)


def intersect(c: Column, o: Column) -> Column:
    return F.array_intersect(c, o)


def exclude(c: Column, o: Column) -> Column:
    """Keeps repeats, unlike array_except."""
    return F.filter(c, lambda x: ~F.array_contains(o, x))


def combine(c: Column, o: Column) -> Column:
    return F.concat(c, o)


def union(c: Column, o: Column) -> Column:
    """Distinct values in order; if one side is empty the other stays as it is, repeats included."""
    return F.when(F.size(c) == 0, o).when(F.size(o) == 0, c).otherwise(F.array_union(c, o))


def member_in(x: Column, c: Column) -> Column:
    """``x in c`` for collections: null if x is empty, false if c is."""
    return F.when(F.size(x) == 1, F.coalesce(F.array_contains(c, F.get(x, F.lit(0))), F.lit(False)))


def contains(c: Column, x: Column) -> Column:
    return member_in(x, c)


def equals(c: Column, o: Column) -> Column:
    """Pairwise in order; null if a side is empty, false if the sizes differ."""
    return F.when((F.size(c) == 0) | (F.size(o) == 0), F.lit(None).cast("boolean")).otherwise(c == o)


def equivalent(c: Column, o: Column) -> Column:
    """Never null; order does not count, and strings compare by their folded form."""
    def fold(v: Column) -> Column:
        return F.array_sort(F.transform(v, lambda x: F.lower(F.trim(F.regexp_replace(x.cast("string"), r"\s+", " ")))))

    return fold(c) == fold(o)


def not_equals(c: Column, o: Column) -> Column:
    return ~equals(c, o)


def not_equivalent(c: Column, o: Column) -> Column:
    return ~equivalent(c, o)


def has_value(c: Column) -> Column:
    return F.size(c) == 1


def sort(c: Column, descending: bool = False) -> Column:
    return F.sort_array(c, not descending)


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def xor(a: Column, b: Column) -> Column:
    return a != b


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def not_(a: Column) -> Column:
    return ~a


def extension(e: Column, url: str) -> Column:
    """Items of an extension array with a url."""
    return F.filter(e, lambda x: x["url"] == url)


def repeat(start: Column, step: Callable[[Column], Column], depth: int) -> Column:
    """Transitive closure of a step down a nested schema of known depth, without repeats."""
    front, out = select(start, step), None
    for _ in range(depth):
        out = front if out is None else F.array_union(out, front)
        front = select(front, step)
    return out


# ---- types: collections of VARIANT values -------------------------------------------------------

# Type names of the path language for the types that a VARIANT reports.
TYPE_NAMES = {"STRING": "String", "BOOLEAN": "Boolean", "BIGINT": "Integer", "DOUBLE": "Decimal", "FLOAT": "Decimal", "DATE": "Date", "TIMESTAMP": "DateTime", "TIMESTAMP_NTZ": "DateTime"}


def type_name(x: Column) -> Column:
    """The type of a VARIANT; objects answer with their resourceType."""
    kind = F.schema_of_variant(x)
    plain = F.try_element_at(F.create_map(*[F.lit(v) for pair in TYPE_NAMES.items() for v in pair]), kind)
    own = F.coalesce(F.try_variant_get(x, "$.resourceType", "string"), F.lit("Object"))
    return F.when(kind.startswith("OBJECT"), own).when(kind.startswith("DECIMAL"), "Decimal").otherwise(plain)


def of_type(c: Column, name: str) -> Column:
    """The values of exactly this type; ``as`` the operator does the same."""
    return F.filter(c, lambda x: F.coalesce(type_name(x) == name, F.lit(False)))


def is_type(c: Column, name: str) -> Column:
    """Of a collection of one; nothing for others."""
    return F.when(F.size(c) == 1, F.coalesce(type_name(F.get(c, F.lit(0))) == name, F.lit(False)))


def as_type(c: Column, name: str) -> Column:
    """The value of a collection of one if it has the type; an error for more."""
    return of_type(single(c), name)


def type_of(c: Column) -> Column:
    """{namespace, name} of each value."""
    return F.transform(c, lambda x: F.struct(F.lit("System").alias("namespace"), type_name(x).alias("name")))


def conforms_to(resource_type: Column, url: str) -> Column:
    """Is the last segment of the url the type's name?"""
    return resource_type == url.rstrip("/").rsplit("/", 1)[-1]
