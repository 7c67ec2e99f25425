"""Search predicates over index tables, and the joins that combine them.

Every predicate returns the keys (resource_type, resource_id) that match. Repeated parameters are an
AND (semi joins one after another), several values of one an OR (one predicate over the same table).
Predicates on different tables under OR or NOT become bits of one aggregated flag (``matching``).
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import cut
from lattica.sources.tables import KEY, normalized


def rows_of(ix: DataFrame, kind: str, parameter: str) -> DataFrame:
    return ix.where((F.col("resource_type") == kind) & (F.col("parameter_name") == parameter))


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts)


def keys(rows: DataFrame, predicate: Column) -> DataFrame:
    """Keys with a matching row, once each: what is returned or counted."""
    return hits(rows, predicate).distinct()


def hits(rows: DataFrame, predicate: Column) -> DataFrame:
    """Keys of matching rows, repeats included: what only goes into a semi or anti join, which needs no distinct."""
    return rows.where(predicate).select(*KEY)


def string_is(values: list[str], modifier: str = "") -> Column:
    """Default: the normalised value starts with the normalised search; ``exact``, ``contains``, ``text`` (words), ``eq``, ``ew`` (ends with)."""
    v, n = F.col("value"), F.col("value_normalized")
    if modifier == "exact":
        return v.isin(values)
    if modifier == "text":
        return _any([words_match(all_of=x.split(), column="value") for x in values])
    search = [normalized(F.lit(x)) for x in values]
    test = {"contains": n.contains, "eq": n.__eq__, "ew": n.endswith}.get(modifier, n.startswith)
    return _any([test(x) for x in search])


def token_is(values: list[str], modifier: str = "") -> Column:
    """``code``, ``system|code``, ``|code`` (no system), ``system|``; ``above``/``below`` by code prefix, ``text`` (display), ``code-text``, ``text-advanced`` (words of the display)."""
    def one(x: str) -> Column:
        system, bar, code = x.rpartition("|")
        c = F.col("code_ci")
        if modifier == "above":
            return c.startswith(code.lower())
        if modifier == "below":
            return F.lit(code.lower()).startswith(c)
        if modifier == "text":
            return F.lower("display").startswith(code.lower())
        if modifier == "code-text":
            return c.startswith(code.lower())
        if modifier == "text-advanced":
            return words_match(all_of=code.split(), column="display")
        by_code = F.col("code") == code if system == "http://unitsofmeasure.org" else c == code.lower()
        if not bar:
            return by_code
        if not code:
            return F.col("system") == system
        return by_code & (F.col("system") == system if system else F.col("system").isNull())

    return _any([one(x) for x in values])


def date_range(literal: str) -> tuple[Column, Column]:
    """The half-open range that a date of any precision names, in UTC."""
    n = len(literal)
    unit = {4: "YEAR", 7: "MONTH", 10: "DAY", 13: "HOUR", 16: "MINUTE", 19: "SECOND"}[n]
    start = F.to_timestamp_ntz(F.lit(literal.replace("T", " ") + "0001-01-01 00:00:00"[n:]))
    return start, start + F.expr(f"INTERVAL 1 {unit}")


def date_is(prefix: str, literal: str) -> Column:
    """The nine prefixes on half-open ranges; ``ne`` is disjointness, not the opposite of ``eq``."""
    low, high = date_range(literal)
    s, e = F.col("start_date"), F.col("end_date")
    if prefix == "ap":  # a tenth of the width, a day at least, on either side
        slack = F.greatest((F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / 10, F.lit(86_400_000_000)).cast("long")
        ms = F.unix_micros(s.cast("timestamp")), F.unix_micros(e.cast("timestamp")), F.unix_micros(low.cast("timestamp")) - slack, F.unix_micros(high.cast("timestamp")) + slack
        return (ms[0] < ms[3]) & (ms[1] > ms[2])
    return {
        "eq": (s >= low) & (e <= high), "ne": (e <= low) | (s >= high), "gt": e > high, "lt": s < low, "ge": e > low, "le": s < high, "sa": s >= high, "eb": e <= low,
        "po": (s < high) & (e > low)}[prefix]


def precision_of(literal: str) -> Decimal:
    """Half a unit of the last digit that a number states."""
    return Decimal(5) * Decimal(10) ** (Decimal(literal).as_tuple().exponent - 1)


def number_is(prefix: str, literal: str) -> Column:
    """Numbers with the precision they state: 100 means 99.5 up to 100.5."""
    n, p, v = Decimal(literal), precision_of(literal), F.col("value")
    low, high = F.lit(n - p), F.lit(n + p)
    return {
        "eq": (v >= low) & (v < high), "ne": (v < low) | (v >= high), "gt": v >= high, "sa": v >= high, "lt": v < low, "eb": v < low, "ge": v >= low, "le": v < high,
        "ap": F.abs(v - F.lit(n)) <= F.lit(max(abs(n) / 10, p))}[prefix]


def quantity_is(prefix: str, literal: str) -> Column:
    """``value``, ``value|system|code``, ``value||code`` (code or unit), ``value|system|``; no unit conversion."""
    value, *unit = literal.split("|")
    p = number_is(prefix, value)
    if not unit:
        return p
    system, code = unit
    if system:
        p = p & (F.col("system") == system)
    if code:
        p = p & ((F.col("code") == code) if system else ((F.col("code") == code) | (F.col("unit") == code)))
    return p


def reference_is(values: list[str]) -> Column:
    """``Type/id``, ``id`` (any type), ``Type/id/_history/v``, an absolute url, ``url|version`` of a canonical, or ``#fragment``.

    A reference without a version matches any; one with a version only that. A canonical's version finds those it begins.
    """
    def one(x: str) -> Column:
        if x.startswith("#"):
            return (F.col("reference_kind") == "fragment") & (F.col("target_id") == x[1:])
        if "|" in x:
            url, version = x.rsplit("|", 1)
            return (F.col("canonical_url") == url) & version_begins(F.col("canonical_version"), version)
        if ":" in x.split("/")[0]:
            return (F.col("target_url") == x) | (F.col("canonical_url") == x)
        x, _, version = x.partition("/_history/")
        kind, _, key = x.rpartition("/")
        p = (F.col("target_id") == key) & (F.col("target_type") == kind if kind else F.lit(True))
        return p & (F.col("target_version_id") == version) if version else p

    return _any([one(x) for x in values])


def version_begins(column: Column, version: str) -> Column:
    """``1.2`` finds 1.2, 1.2.3 and 1.2-draft."""
    return (column == version) | column.startswith(version + ".") | column.startswith(version + "-")


def version_order(column: Column) -> Column:
    """A dotted version as six numbers, which compare in order; null if a part is no number."""
    parts = F.transform(F.split(column, r"[.]"), lambda x: x.try_cast("bigint"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 6)), 1, 6)
    return F.when(~F.exists(padded, lambda x: x.isNull()), padded)


def canonical_is(value: str, modifier: str) -> Column:
    """``url|version`` with ``above`` (that version or later) or ``below`` (that version or earlier)."""
    url, version = value.rsplit("|", 1)
    own, asked = version_order(F.col("canonical_version")), F.array(*[F.lit(int(x)).cast("bigint") for x in (version.split(".") + ["0"] * 6)[:6]])
    return (F.col("canonical_url") == url) & (own >= asked if modifier == "above" else own <= asked)


def identifier_is(values: list[str]) -> Column:
    """``:identifier`` and ``:of-type`` (``system|code|value``) on rows of identifiers."""
    def one(x: str) -> Column:
        parts = x.split("|")
        if len(parts) < 3:
            return token_is([x])
        p = (F.col("type_code_ci") == parts[1].lower()) & (F.col("value_ci") == parts[2].lower())
        return p & (F.col("type_system") == parts[0]) if parts[0] else p

    return _any([one(x) for x in values])


def id_is(values: list[str]) -> Column:
    """``_id``."""
    return F.col("resource_id").isin(values)


def last_updated_is(prefix: str, literal: str) -> Column:
    """``_lastUpdated``: the nine prefixes and ``po`` on an instant."""
    low, high = date_range(literal)
    at = F.col("last_updated")
    if prefix == "ap":
        slack = F.greatest((F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / 10, F.lit(86_400_000_000)).cast("long")
        us = F.unix_micros(at.cast("timestamp"))
        return (us >= F.unix_micros(low.cast("timestamp")) - slack) & (us < F.unix_micros(high.cast("timestamp")) + slack)
    inside = (at >= low) & (at < high)
    return {"eq": inside, "po": inside, "ne": ~inside, "gt": at >= high, "sa": at >= high, "lt": at < low, "eb": at < low, "ge": at >= low, "le": at < high}[prefix]


def uri_is(values: list[str], modifier: str = "", column: str = "value") -> Column:
    """Exact, ``contains`` (normalised), or ``below``/``above`` at boundaries of path segments."""
    v = F.regexp_replace(F.col(column), "/+$", "")

    def one(x: str) -> Column:
        x = x.rstrip("/")
        if modifier == "below":
            return (v == x) | v.startswith(x + "/")
        if modifier == "above":
            return (v == x) | F.lit(x).startswith(F.concat(v, F.lit("/")))
        if modifier == "contains":
            return F.lower(v).contains(x.lower())
        return F.col(column) == x

    return _any([one(x) for x in values])


def words_match(all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), phrase: str = "", column: str = "content") -> Column:
    """Full text on lower-cased words (letters and digits)."""
    lower = F.lower(F.col(column))
    text = F.concat(F.lit(" "), F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " "), F.lit(" "))

    def has(w: str) -> Column:
        return text.contains(f" {w.lower()} ")

    p = reduce(Column.__and__, [lower.contains(w.lower()) for w in all_of], F.lit(True))  # cheap, before words are made out
    p = reduce(Column.__and__, [has(w) for w in all_of], p)
    if any_of:
        p = p & _any([has(w) for w in any_of])
    for w in none_of:
        p = p & ~has(w)
    return p & has(phrase) if phrase else p


def composite_is(*parts: Column) -> Column:
    """All parts on one row of an index whose columns hold the components of one tuple."""
    return reduce(Column.__and__, parts)


# ---- joins --------------------------------------------------------------------------------------


def only(base: DataFrame, found: DataFrame) -> DataFrame:
    """AND: resources whose key is among ``found``."""
    return base.join(found, KEY, "left_semi")


def without(base: DataFrame, found: DataFrame) -> DataFrame:
    """NOT and ``:missing``: resources whose key is not among ``found``."""
    return base.join(found, KEY, "left_anti")


def token_in(rows: DataFrame, expansion: DataFrame) -> DataFrame:
    """``:in``: keys with a code of an expansion (system, code)."""
    codes = expansion.select("system", F.lower("code").alias("code_ci")).distinct()
    return rows.join(codes, ["system", "code_ci"], "left_semi").select(*KEY).distinct()


def token_not_in(rows: DataFrame, expansion: DataFrame) -> DataFrame:
    """``:not-in``: keys none of whose codes is in an expansion."""
    return without(rows.select(*KEY).distinct(), token_in(rows, expansion))


def missing(base: DataFrame, ix: DataFrame, kind: str, parameter: str, absent: bool = True) -> DataFrame:
    """``:missing``: resources without (or with) any value of a parameter."""
    seen = rows_of(ix, kind, parameter).select(*KEY)
    return without(base, seen) if absent else only(base, seen)


def resolve(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """``resolve()``: reference rows with the document that they name, null where there is none."""
    have = documents.withColumnsRenamed({"resource_type": "target_type", "resource_id": "target_id"})
    return refs.join(have, ["target_type", "target_id"], "left")


def edges_within(refs: DataFrame, page: DataFrame) -> DataFrame:
    """References whose two ends are both in a set of resources."""
    to = page.select(F.col("resource_type").alias("target_type"), F.col("resource_id").alias("target_id"))
    return refs.join(page.select(*KEY), KEY, "left_semi").join(to, ["target_type", "target_id"], "left_semi")


def edges_of(refs: DataFrame, kind: str, key: str, incoming: bool = False, count: int = 200) -> DataFrame:
    """Outgoing or incoming references of one resource, the first ``count``."""
    a, b = ("target_type", "target_id") if incoming else tuple(KEY)
    found = refs.where((F.col(a) == kind) & (F.col(b) == key))
    return found.orderBy("parameter_name", *KEY, "target_type", "target_id").limit(count)


# The type that a chain without a type is taken to mean, by the name of the reference.
CHAIN_TARGETS = {"subject": "Patient", "patient": "Patient", "performer": "Organization", "organization": "Organization", "context": "Encounter", "encounter": "Encounter", "address": "Location", "location": "Location", "partof": "Location", "medication": "Medication"}


def chain_target(parameter: str, kind: str | None = None) -> str:
    """The target type of a chain: as stated, else by the name of the reference."""
    if kind:
        return kind
    if parameter not in CHAIN_TARGETS:
        raise ValueError(f"the target of {parameter} is not known; state its type")
    return CHAIN_TARGETS[parameter]


def matching(base: DataFrame, predicates: dict[str, DataFrame], condition: str) -> DataFrame:
    """Resources for which a formula over named predicates holds, e.g. ``a AND (b OR NOT c)``.

    The keys of all predicates are tagged with a bit and aggregated once; the formula is an expression
    over boolean columns of those names.
    """
    bits = [found.select(*KEY, F.lit(1 << i).cast("long").alias("bit")) for i, found in enumerate(predicates.values())]
    flags = reduce(DataFrame.unionByName, bits).groupBy(*KEY).agg(F.bit_or("bit").alias("bits"))
    joined = base.join(flags, KEY, "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    named = joined.withColumns({name: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(predicates)})
    return named.where(F.expr(condition)).select(base.columns)


def chained(refs: DataFrame, kind: str, parameter: str, target: str, found: DataFrame) -> DataFrame:
    """Forward chain ``parameter:target.x=y``: keys of ``kind`` that refer to one of ``found``."""
    to = found.select(F.col("resource_type").alias("target_type"), F.col("resource_id").alias("target_id"))
    return rows_of(refs, kind, parameter).where(F.col("target_type") == target).join(to, ["target_type", "target_id"], "left_semi").select(*KEY).distinct()


def referred_by(refs: DataFrame, kind: str, parameter: str, target: str, found: DataFrame) -> DataFrame:
    """Reverse chain ``_has:kind:parameter:x=y``: keys of ``target`` that one of ``found`` refers to."""
    rows = rows_of(refs, kind, parameter).where(F.col("target_type") == target)
    return rows.join(found, KEY, "left_semi").select(F.col("target_type").alias("resource_type"), F.col("target_id").alias("resource_id")).distinct()


def include(refs: DataFrame, page: DataFrame, kind: str, parameter: str) -> DataFrame:
    """``_include``: what the rows of a page refer to, once each."""
    return rows_of(refs, kind, parameter).join(page.select(*KEY), KEY, "left_semi").select(F.col("target_type").alias("resource_type"), F.col("target_id").alias("resource_id")).distinct()


def revinclude(refs: DataFrame, page: DataFrame, kind: str, parameter: str) -> DataFrame:
    """``_revinclude``: what refers to the rows of a page, once each."""
    to = page.select(F.col("resource_type").alias("target_type"), F.col("resource_id").alias("target_id"))
    return rows_of(refs, kind, parameter).join(to, ["target_type", "target_id"], "left_semi").select(*KEY).distinct()


def include_iterate(refs: DataFrame, page: DataFrame, steps: list[tuple[str, str]], passes: int = 3) -> DataFrame:
    """``_include:iterate``: includes of includes, at most ``passes`` deep, without rows seen before."""
    seen = page.select(*KEY).distinct()
    front, out = seen, None
    for _ in range(passes):
        found = reduce(DataFrame.unionByName, [include(refs, front, kind, p) for kind, p in steps]).distinct()
        front = cut(found.join(seen, KEY, "left_anti"))
        out = front if out is None else out.unionByName(front)
        seen = seen.unionByName(front)
    return out


def compartment(refs: DataFrame, target: str, key: str, members: list[tuple[str, str]]) -> DataFrame:
    """Keys in the compartment of one resource: itself, and what refers to it by a member parameter."""
    cond = _any([(F.col("resource_type") == k) & (F.col("parameter_name") == p) for k, p in members])
    rows = refs.where(cond & (F.col("target_type") == target) & (F.col("target_id") == key)).select(*KEY).distinct()
    spark = refs.sparkSession
    return rows.unionByName(spark.createDataFrame([(target, key)], "resource_type string, resource_id string"))


def member_of(edges: DataFrame, collection: str, key: str, at: Column) -> DataFrame:
    """``_in``: active members of a collection at an instant; edges have period_start, period_end, inactive."""
    inside = (F.col("period_start").isNull() | (F.col("period_start") <= at)) & (F.col("period_end").isNull() | (F.col("period_end") >= at))
    rows = edges.where((F.col("collection_type") == collection) & (F.col("collection_id") == key) & ~F.coalesce("member_inactive", F.lit(False)) & inside)
    return rows.select(F.col("member_type").alias("resource_type"), F.col("member_id").alias("resource_id")).distinct()


def on_list(edges: DataFrame, key: str) -> DataFrame:
    """``_list``: members of a List, whatever their period."""
    rows = edges.where((F.col("collection_type") == "List") & (F.col("collection_id") == key))
    return rows.select(F.col("member_type").alias("resource_type"), F.col("member_id").alias("resource_id")).distinct()


def dangling(refs: DataFrame, existing: DataFrame) -> DataFrame:
    """Referential integrity: reference rows whose target does not exist."""
    have = existing.select(F.col("resource_type").alias("target_type"), F.col("resource_id").alias("target_id")).distinct()
    return refs.join(have, ["target_type", "target_id"], "left_anti")


# ---- order, pages, totals -----------------------------------------------------------------------


def sort_key(ix: DataFrame, kind: str, parameter: str, column: str) -> DataFrame:
    """The least indexed value of each resource."""
    return rows_of(ix, kind, parameter).groupBy(*KEY).agg(F.min(column).alias("sort_key"))


def sorted_page(base: DataFrame, key: DataFrame, descending: bool, count: int) -> DataFrame:
    """The first ``count`` resources by a sort key, nulls last either way, ties by id."""
    k = F.col("sort_key")
    return base.join(key, KEY, "left").orderBy(k.desc_nulls_last() if descending else k.asc_nulls_last(), "resource_id").limit(count)


def keyset_page(rows: DataFrame, cursor: tuple[Column, Column] | None, count: int, when: str = "last_updated", key: str = "id", back: bool = False) -> DataFrame:
    """The page after (or, ``back``, before) a cursor in the default order, newest first; the last page is ``back`` without a cursor."""
    if cursor is not None:
        at, last = cursor
        w, k = F.col(when), F.col(key)
        rows = rows.where((w > at) | ((w == at) & (k > last)) if back else (w < at) | ((w == at) & (k < last)))
    if back:
        return rows.orderBy(F.asc(when), F.asc(key)).limit(count).orderBy(F.desc(when), F.desc(key))
    return rows.orderBy(F.desc(when), F.desc(key)).limit(count)


def sorted_by(base: DataFrame, sort_keys: list[tuple[DataFrame, bool]], count: int) -> DataFrame:
    """``_sort`` by several keys, each (its least or greatest values by resource, descending); nulls last, ties by id."""
    order = []
    for i, (key, descending) in enumerate(sort_keys):
        base = base.join(key.select(*KEY, F.col("sort_key").alias(f"sort_{i}")), KEY, "left")
        order.append(F.col(f"sort_{i}").desc_nulls_last() if descending else F.col(f"sort_{i}").asc_nulls_last())
    return base.orderBy(*order, "resource_id").limit(count)


# What one request may ask for.
LIMITS = {"count": 1000, "total": 10_000, "iterate": 3, "includes": 10}


def checked(**asked: int) -> dict[str, int]:
    """Limits guard: raises for more than ``LIMITS`` or less than nothing."""
    for name, n in asked.items():
        if not 0 <= n <= LIMITS[name]:
            raise ValueError(f"{name} is {n}; 0 to {LIMITS[name]} are allowed")
    return asked
