"""Sources: Parquet tables as versioned documents and as typed index rows.

Index rows share the key (resource_type, resource_id, parameter_name). A filter on the first and the
last prunes the branches of the unions below before anything is read; tables written with
``write_index`` are partitioned by the same two columns, so the filter prunes folders there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["resource_type", "resource_id"]
#: Numbers of indexes: exact decimals.
NUMBER = "decimal(28,9)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rid(prefix: str, col: str) -> Column:
    """A logical id from a key: ``c-17``."""
    return F.concat(F.lit(prefix + "-"), F.col(col).cast("string"))


def _rows(df: DataFrame, kind: str, key: Column, parameter: str, **values: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("resource_type"), key.alias("resource_id"), F.lit(parameter).alias("parameter_name"), *[v.alias(k) for k, v in values.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def normalized(col: Column) -> Column:
    """Lower case, letters and digits only; for text without accents (see ``folded`` for others)."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")


def string_index(spark: SparkSession, d: str) -> DataFrame:
    """value, value_normalized of name-like parameters."""
    return _union([
        _rows(table(spark, d, t), kind, rid(p, k), name, value=F.col(v), value_normalized=normalized(F.col(v)))
        for t, kind, p, k, name, v in [
            ("customer", "Patient", "c", "c_custkey", "name", "c_name"), ("supplier", "Organization", "s", "s_suppkey", "name", "s_name"),
            ("part", "Medication", "p", "p_partkey", "name", "p_name"), ("nation", "Location", "n", "n_nationkey", "name", "n_name"), ("region", "Location", "r", "r_regionkey", "name", "r_name")]])


def token_index(spark: SparkSession, d: str) -> DataFrame:
    """system, code, code_ci, display of coded parameters."""
    coded = [
        _rows(table(spark, d, t), kind, rid(p, k), name, system=F.lit("urn:" + s), code=F.col(v), code_ci=F.lower(v), display=F.initcap(v))
        for t, kind, p, k, name, s, v in [
            ("customer", "Patient", "c", "c_custkey", "segment", "segment", "c_mktsegment"), ("orders", "Encounter", "o", "o_orderkey", "status", "status", "o_orderstatus"),
            ("orders", "Encounter", "o", "o_orderkey", "priority", "priority", "o_orderpriority"), ("part", "Medication", "p", "p_partkey", "brand", "brand", "p_brand"),
            ("part", "Medication", "p", "p_partkey", "type", "type", "p_type"), ("events", "Observation", "e", "event_id", "code", "event", "event_type")]]
    active = (F.col("c_acctbal") >= 0).cast("string")
    coded.append(_rows(table(spark, d, "customer"), "Patient", rid("c", "c_custkey"), "active", system=F.lit(None).cast("string"), code=active, code_ci=active, display=F.lit(None).cast("string")))
    return _union(coded)


def date_index(spark: SparkSession, d: str) -> DataFrame:
    """start_date, end_date, half open: a day for encounters, a second for observations."""
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    day, second = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz")
    return _union([
        _rows(o, "Encounter", rid("o", "o_orderkey"), "date", start_date=day, end_date=day + F.expr("INTERVAL 1 DAY")),
        _rows(e, "Observation", rid("e", "event_id"), "date", start_date=second, end_date=second + F.expr("INTERVAL 1 SECOND"))])


def number_index(spark: SparkSession, d: str) -> DataFrame:
    return _union([
        _rows(table(spark, d, t), kind, rid(p, k), name, value=F.col(v).cast(NUMBER))
        for t, kind, p, k, name, v in [("customer", "Patient", "c", "c_custkey", "balance", "c_acctbal"), ("part", "Medication", "p", "p_partkey", "size", "p_size"), ("orders", "Encounter", "o", "o_orderkey", "total", "o_totalprice")]])


def quantity_index(spark: SparkSession, d: str) -> DataFrame:
    """value, system, code, unit. Values are in mg for purchases, in g for other events."""
    e = table(spark, d, "events")
    unit = F.when(F.col("event_type") == "purchase", "mg").otherwise("g")
    return _rows(e, "Observation", rid("e", "event_id"), "value-quantity", value=F.col("value").cast(NUMBER), system=F.lit("http://unitsofmeasure.org"), code=unit, unit=unit)


def reference_index(spark: SparkSession, d: str) -> DataFrame:
    """target_type, target_id of reference parameters."""
    dispense = F.concat_ws("-", F.lit("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    li = table(spark, d, "lineitem")

    def ref(df, kind, key, name, target, to):
        return _rows(df, kind, key, name, target_type=F.lit(target), target_id=to)

    return _union([
        ref(table(spark, d, "orders"), "Encounter", rid("o", "o_orderkey"), "subject", "Patient", rid("c", "o_custkey")),
        ref(table(spark, d, "events"), "Observation", rid("e", "event_id"), "subject", "Patient", rid("c", "user_id")),
        ref(table(spark, d, "customer"), "Patient", rid("c", "c_custkey"), "address", "Location", rid("n", "c_nationkey")),
        ref(table(spark, d, "supplier"), "Organization", rid("s", "s_suppkey"), "address", "Location", rid("n", "s_nationkey")),
        ref(table(spark, d, "nation"), "Location", rid("n", "n_nationkey"), "partof", "Location", rid("r", "n_regionkey")),
        ref(li, "MedicationDispense", dispense, "context", "Encounter", rid("o", "l_orderkey")),
        ref(li, "MedicationDispense", dispense, "medication", "Medication", rid("p", "l_partkey")),
        ref(li, "MedicationDispense", dispense, "performer", "Organization", rid("s", "l_suppkey"))])


def text_index(spark: SparkSession, d: str) -> DataFrame:
    """content: one row per document or page."""
    return _union([
        _rows(table(spark, d, "documents"), "DocumentReference", rid("doc", "doc_id"), "_content", content=F.col("text")),
        _rows(table(spark, d, "pages"), "Composition", rid("page", "page_id"), "_text", content=narrative(F.col("html")))])


def narrative(html: Column) -> Column:
    """Text of markup: tags become spaces, six entities are decoded, white space collapses."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def encounters(spark: SparkSession, d: str) -> DataFrame:
    """Versions of encounters: one to three each, a day apart; every 17th ends deleted."""
    o = table(spark, d, "orders").withColumn("last", (F.col("o_orderkey") % 3 + 1).cast("int"))
    v = o.withColumn("version_id", F.explode(F.sequence(F.lit(1), F.col("last"))))
    return v.select(
        F.lit("Encounter").alias("resource_type"), rid("o", "o_orderkey").alias("id"), "version_id", (F.col("o_orderdate") + F.make_dt_interval(F.col("version_id") - 1)).alias("last_updated"),
        F.when(F.col("version_id") == F.col("last"), F.col("o_orderstatus")).otherwise("O").alias("status"), ((F.col("version_id") == F.col("last")) & (F.col("o_orderkey") % 17 == 0)).alias("deleted"),
        (F.col("version_id") == F.col("last")).alias("is_current"), F.col("o_totalprice").alias("total"))


def patient_documents(spark: SparkSession, d: str) -> DataFrame:
    """(id, resource): patients as JSON text, the shape in which documents arrive."""
    c = table(spark, d, "customer")
    body = F.struct(
        F.lit("Patient").alias("resourceType"), rid("c", "c_custkey").alias("id"), F.array(F.struct(F.col("c_name").alias("family"), F.array(F.lower("c_mktsegment")).alias("given"))).alias("name"),
        F.array(F.struct(F.lit("urn:mrn").alias("system"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("value"))).alias("identifier"), (F.col("c_acctbal") >= 0).alias("active"))
    return c.select(rid("c", "c_custkey").alias("id"), F.to_json(body).alias("resource"))


def write_index(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Bulk sink: index rows without repeats, a folder per type and parameter."""
    rows.dropDuplicates().repartition("resource_type", "parameter_name", F.pmod(F.xxhash64("resource_id"), F.lit(16))).write.mode(mode).partitionBy("resource_type", "parameter_name").parquet(path)


def documents_from_directory(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON documents, one each file: (path, resource)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("resource"))


def documents_from_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Documents of XML files as JSON text."""
    df = spark.read.option("rowTag", row_tag).xml(path)
    return df.select(F.to_json(F.struct("*")).alias("resource"))


def identifier_index(spark: SparkSession, d: str) -> DataFrame:
    """system, value, value_ci and the type's system and code of identifiers; code, code_ci for token predicates."""
    c = table(spark, d, "customer")
    value = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    return _rows(c, "Patient", rid("c", "c_custkey"), "identifier", system=F.lit("urn:mrn"), code=value, code_ci=F.lower(value), value=value, value_ci=F.lower(value), type_system=F.lit("urn:identifier-type"), type_code=F.lit("MR"), type_code_ci=F.lit("mr"))


def reference_identifier_index(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers by which encounters name their subject."""
    value = F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    return _rows(table(spark, d, "orders"), "Encounter", rid("o", "o_orderkey"), "subject", system=F.lit("urn:mrn"), code=value, code_ci=F.lower(value))


def literal_index(spark: SparkSession, d: str) -> DataFrame:
    """References of every shape as edge columns: relative with a version, absolute, canonical with a version, fragment."""
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).otherwise(v[3])
    none = F.lit(None).cast("string")
    return _rows(
        table(spark, d, "part"), "Medication", rid("p", "p_partkey"), "derived", reference_kind=pick(*map(F.lit, ("relative", "absolute", "canonical", "fragment"))),
        target_type=pick(F.lit("Substance"), F.lit("Substance"), none, none), target_id=pick(size, size, none, F.concat(F.lit("c"), size)), target_version_id=pick(F.lit("2"), none, none, none),
        target_url=pick(none, F.concat(F.lit("https://h.org/r4/Substance/"), size), none, none), canonical_url=pick(none, none, F.lit("http://h.org/KnowledgeBase"), none),
        canonical_version=pick(none, none, F.concat_ws(".", F.lit("1"), size), none))


def metadata_index(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, references and uris that every document may carry: _language, _source, _tag, _security, _profile."""
    docs = table(spark, d, "documents")
    key = rid("doc", "doc_id")
    none = F.lit(None).cast("string")

    def one(parameter, system=none, code=none, value=none, where=None):
        return _rows(docs if where is None else docs.where(where), "DocumentReference", key, parameter, system=system, code=code, code_ci=F.lower(code), value=value)

    return _union([
        one("_language", F.lit("urn:ietf:bcp:47"), F.col("lang")), one("_source", value=F.concat(F.lit("https://"), F.col("source"), F.lit("/feed"))),
        one("_tag", F.lit("urn:tag"), F.when(F.col("n_chars") > 1000, "long").otherwise("short")), one("_security", F.lit("urn:label"), F.lit("R"), where="doc_id % 7 = 0"),
        one("_profile", value=F.lit("http://h.org/profiles/note"), where="doc_id % 2 = 0")])


def documents_to_xml(docs: DataFrame, schema: str, row_tag: str, column: str = "resource") -> DataFrame:
    """JSON text documents as XML text, one element of ``row_tag`` each."""
    x = F.to_xml(F.from_json(column, schema), {"rowTag": row_tag})
    return docs.withColumn("xml", F.regexp_replace(F.regexp_replace(x, r"^<\?xml[^>]*>\s*", ""), r">\s+<", "><"))
