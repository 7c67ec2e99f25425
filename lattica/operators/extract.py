"""Index extraction: typed rows from nested documents, as one select with an explode for each parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.tables import narrative, normalized

#: Pairs of a composite's components that one document may give.
MOST_TUPLES = 2000


def index_rows(docs: DataFrame, key: Column, kind: str, parameter: str, values: Column) -> DataFrame:
    """A row for each struct of an array column, its fields as columns; repeats are dropped."""
    rows = docs.select(F.lit(kind).alias("resource_type"), key.alias("resource_id"), F.lit(parameter).alias("parameter_name"), F.explode(values).alias("v"))
    return rows.select("resource_type", "resource_id", "parameter_name", "v.*").dropDuplicates()


def token(system: Column, code: Column) -> Column:
    return F.struct(system.alias("system"), code.alias("code"), F.lower(code).alias("code_ci"))


def coding_tokens(codings: Column) -> Column:
    """Tokens of an array of codings with system and code."""
    return F.transform(F.filter(codings, lambda c: c["code"].isNotNull()), lambda c: token(c["system"], c["code"]))


def identifier_tokens(identifiers: Column) -> Column:
    return F.transform(F.filter(identifiers, lambda c: c["value"].isNotNull()), lambda c: token(c["system"], c["value"]))


def name_strings(names: Column) -> Column:
    """Parts of human names: family, given names, and the pieces of a family name."""
    families = F.filter(F.transform(names, lambda n: n["family"]), lambda x: x.isNotNull())
    given = F.flatten(F.transform(names, lambda n: F.coalesce(n["given"], F.array().cast("array<string>"))))
    pieces = F.flatten(F.transform(families, lambda x: F.filter(F.split(x, r"[ \-_,;.]+"), lambda y: y != "")))
    return F.transform(F.array_distinct(F.concat(families, pieces, given)), lambda x: F.struct(x.alias("value"), normalized(x).alias("value_normalized")))


def parsed_reference(x: Column) -> Column:
    """struct(kind, target_type, target_id, version, url) of a literal reference.

    Kinds: fragment ``#a``, relative ``Type/id[/_history/v]``, absolute ``http.../Type/id``, canonical ``url|version``.
    """
    local = r"(?:^|/)([A-Z][A-Za-z]+)/([A-Za-z0-9\-.]{1,64})(?:/_history/([A-Za-z0-9\-.]+))?$"
    kind = F.when(x.startswith("#"), "fragment").when(x.contains("|"), "canonical").when(x.rlike("^[A-Z][A-Za-z]+/"), "relative").when(x.rlike("^[a-z]+:"), "absolute")
    plain = ~x.startswith("#") & ~x.contains("|")

    def part(i: int) -> Column:
        return F.when(plain, F.nullif(F.regexp_extract(x, local, i), F.lit("")))

    version = F.when(x.contains("|"), F.substring_index(x, "|", -1)).otherwise(part(3))
    url = F.when(x.contains("|"), F.substring_index(x, "|", 1)).when(kind == "absolute", x)
    return F.struct(kind.alias("kind"), part(1).alias("target_type"), part(2).alias("target_id"), version.alias("version"), url.alias("url"))


def date_range(x: Column) -> Column:
    """struct(start_date, end_date), half open, of a date of any precision; null if it is none."""
    n = F.length(x)
    full = F.concat(F.replace(x, F.lit("T"), F.lit(" ")), F.substring(F.lit("0001-01-01 00:00:00"), n + 1, F.lit(19)))
    start = F.expr("NULL").cast("timestamp_ntz")
    start = F.when(x.rlike(r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?)?)?)?$"), full.try_cast("timestamp_ntz")).otherwise(start)
    end = F.when(n == 4, start + F.expr("INTERVAL 1 YEAR")).when(n == 7, start + F.expr("INTERVAL 1 MONTH")).when(n == 10, start + F.expr("INTERVAL 1 DAY")).when(n == 16, start + F.expr("INTERVAL 1 MINUTE")).otherwise(start + F.expr("INTERVAL 1 SECOND"))
    return F.when(start.isNotNull(), F.struct(start.alias("start_date"), end.alias("end_date")))


def period_range(start: Column, end: Column) -> Column:
    """Range of a period; open ends reach to the first or last representable year."""
    low, high = date_range(F.coalesce(start, F.lit("0001"))), date_range(F.coalesce(end, F.lit("9998")))
    return F.struct(low["start_date"].alias("start_date"), high["end_date"].alias("end_date"))


def composite_tuples(left: Column, right: Column) -> Column:
    """All pairs of two component arrays of one element, at most ``MOST_TUPLES`` of a document."""
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return F.slice(pairs, 1, MOST_TUPLES)


def all_text(html: Column, *others: Column) -> Column:
    """Narrative and other texts of a document, each once."""
    parts = F.filter(F.array(narrative(html), *others), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.array_join(F.array_distinct(parts), " ")


def number_values(x: Column) -> Column:
    """Numbers, or text of numbers, as exact decimals; other text gives nothing."""
    return F.transform(F.filter(F.transform(x, lambda v: v.cast("string").try_cast("decimal(28,9)")), lambda v: v.isNotNull()), lambda v: F.struct(v.alias("value")))


def quantity_values(x: Column) -> Column:
    """value, system, code, unit of quantities that have a value."""
    return F.transform(F.filter(x, lambda q: q["value"].isNotNull()), lambda q: F.struct(q["value"].cast("decimal(28,9)").alias("value"), q["system"].alias("system"), q["code"].alias("code"), q["unit"].alias("unit")))


def identifier_types(identifiers: Column) -> Column:
    """A row for each coding of an identifier's type, with its value."""
    def rows(i: Column) -> Column:
        return F.transform(i["type"]["coding"], lambda c: F.struct(c["system"].alias("type_system"), c["code"].alias("type_code"), F.lower(c["code"]).alias("type_code_ci"), i["value"].alias("value"), F.lower(i["value"]).alias("value_ci")))

    return F.flatten(F.transform(F.filter(identifiers, lambda i: i["value"].isNotNull() & i["type"]["coding"].isNotNull()), rows))


def concept_tokens(concepts: Column) -> Column:
    """Tokens of codeable concepts: those of all their codings."""
    return F.flatten(F.transform(F.filter(concepts, lambda c: c["coding"].isNotNull()), lambda c: coding_tokens(c["coding"])))


def contact_tokens(contacts: Column) -> Column:
    """Telephone numbers and the like: the use stands in for a system."""
    return F.transform(F.filter(contacts, lambda c: c["value"].isNotNull()), lambda c: token(c["use"], c["value"]))


def scalar_tokens(x: Column) -> Column:
    """Codes and booleans as tokens without a system."""
    return F.transform(F.filter(x, lambda v: v.isNotNull()), lambda v: token(F.lit(None).cast("string"), v.cast("string")))


def date_ranges(dates: Column, periods: Column) -> Column:
    """Ranges of dates and of periods with open ends."""
    both = F.concat(F.transform(dates, date_range), F.transform(periods, lambda p: period_range(p["start"], p["end"])))
    return F.array_distinct(F.filter(both, lambda r: r.isNotNull()))


# The extraction that a parameter's type asks for.
BY_TYPE = {"token": identifier_tokens, "string": name_strings, "number": number_values, "quantity": quantity_values}


def routed(docs: DataFrame, key: Column, kind: str, parameters: list[tuple[str, str, Column]]) -> dict[str, DataFrame]:
    """Parameter router: (name, type, elements) to one table of index rows for each type; types without a table are skipped."""
    out: dict[str, DataFrame] = {}
    for name, of, column in parameters:
        if of in BY_TYPE:
            rows = index_rows(docs, key, kind, name, BY_TYPE[of](column))
            out[of] = rows if of not in out else out[of].unionByName(rows)
    return out


def resolved_parameters(parameters: DataFrame, kind: str) -> DataFrame:
    """Parameters of a type: its own definition of a code goes before that of DomainResource, and that before Resource's."""
    rank = F.when(F.col("base") == kind, 0).when(F.col("base") == "DomainResource", 1).when(F.col("base") == "Resource", 2)
    rest = [c for c in parameters.columns if c != "code"]
    best = parameters.where(rank.isNotNull()).groupBy("code").agg(F.min_by(F.struct(*rest), rank).alias("p"))
    return best.select("code", "p.*")


def compartments(definitions: DataFrame) -> DataFrame:
    """(compartment, resource_type, parameter_name) of definitions with resource: array of (code, param array)."""
    rows = definitions.select(F.col("code").alias("compartment"), F.explode("resource").alias("r"))
    return rows.select("compartment", F.col("r.code").alias("resource_type"), F.explode("r.param").alias("parameter_name")).distinct()


def code_system_concepts(systems: DataFrame, depth: int) -> DataFrame:
    """(system, code, display, parent) of nested concepts, level by level down to ``depth``."""
    level = systems.select(F.col("url").alias("system"), F.lit(None).cast("string").alias("parent"), F.explode("concept").alias("c"))
    out = None
    for i in range(depth):
        rows = level.select("system", F.col("c.code").alias("code"), F.col("c.display").alias("display"), "parent")
        out = rows if out is None else out.unionByName(rows)
        if i + 1 < depth:
            level = level.select("system", F.col("c.code").alias("parent"), F.explode("c.concept").alias("c"))
    return out


def concept_map_rows(maps: DataFrame) -> DataFrame:
    """Groups, elements and targets of concept maps as mapping rows."""
    g = maps.select(F.explode("group").alias("g"))
    e = g.select("g.source", "g.target", F.explode("g.element").alias("e"))
    t = e.select(F.col("source").alias("source_system"), F.col("target").alias("target_system"), F.col("e.code").alias("source_code"), F.explode("e.target").alias("t"))
    return t.select("source_system", "source_code", "target_system", F.col("t.code").alias("target_code"), F.col("t.equivalence").alias("equivalence"))


def membership_edges(groups: DataFrame, kind: str, key: str, members: str, active: Column) -> DataFrame:
    """(collection_type, collection_id, member_type, member_id) of active collections; members are references."""
    m = groups.where(active).select(F.lit(kind).alias("collection_type"), F.col(key).alias("collection_id"), F.explode(members).alias("m"))
    return m.withColumn("r", parsed_reference(F.col("m"))).where("r.target_id IS NOT NULL").select("collection_type", "collection_id", F.col("r.target_type").alias("member_type"), F.col("r.target_id").alias("member_id")).distinct()
