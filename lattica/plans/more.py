"""Queries of path functions, search, extraction, terminology and administration that the other modules leave open."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import collections as C
from lattica.functions import scalars as S
from lattica.functions import temporal
from lattica.operators import extract, hierarchy, history, reports, rules, search, shape, terminology, units
from lattica.plans.queries import _ids, _tree, _VERSIONS, query
from lattica.sources import tables as T

# ---- operators and path functions ---------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_suppkey AS added, l_partkey - l_suppkey AS less, l_partkey * l_suppkey AS times, round(l_partkey::DOUBLE / nullif(l_suppkey % 5, 0), 6) AS ratio,
-l_partkey AS negative, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '') || l_linestatus AS joined FROM lineitem""")
def fp_operators(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.add(p, s).alias("added"), S.subtract(p, s).alias("less"), S.multiply(p, s).alias("times"), F.round(S.divide(p, s % 5).cast("double"), 6).alias("ratio"),
        S.negate(p).alias("negative"), S.concatenate(flag, F.col("l_linestatus")).alias("joined"))


_WORDS = "SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ring red', ' ') AS b FROM part"


@query(f"""SELECT p_partkey, a = b AS same, a <> b AS other, list_sort(a) = list_sort(b) AS alike, list_sort(a) <> list_sort(b) AS unlike, a = list_reverse(list_reverse(a)) AS own, list_contains(a, 'ring') AS has, list_contains(b, a[1]) AS inside,
len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS sub, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS super FROM ({_WORDS})""")
def fp_equality(spark, d):
    a, b = F.split("p_name", " "), F.split(F.concat(F.lower("p_type"), F.lit(" ring red")), " ")
    return T.table(spark, d, "part").select(
        "p_partkey", C.equals(a, b).alias("same"), C.not_equals(a, b).alias("other"), C.equivalent(a, b).alias("alike"), C.not_equivalent(a, b).alias("unlike"), C.equals(a, a).alias("own"), C.contains(a, C.lift(F.lit("ring"))).alias("has"),
        C.member_in(C.first(a), b).alias("inside"), C.subset_of(a, b).alias("sub"), C.superset_of(a, b).alias("super"))


@query("""SELECT o_orderkey, a AND b AS both, a OR b AS either, (a <> b) AS one, (NOT a) OR b AS then_b, NOT a AS no_a, CASE WHEN a THEN 'yes' WHEN NOT a THEN 'no' ELSE 'unknown' END AS chosen
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice > 50000 END AS b FROM orders)""")
def fp_logic(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") > 50000).alias("b"))
    a, b = F.col("a"), F.col("b")
    return o.select("o_orderkey", C.and_(a, b).alias("both"), C.or_(a, b).alias("either"), C.xor(a, b).alias("one"), C.implies(a, b).alias("then_b"), C.not_(a).alias("no_a"), C.iif(a, F.lit("yes"), C.iif(~a, F.lit("no"), F.lit("unknown"))).alias("chosen"))


@query("""SELECT l_orderkey, bool_and(q > 10) AS all_true, bool_or(q > 10) AS any_true, bool_and(NOT q > 10) AS all_false, bool_or(NOT q > 10) AS any_false, count(DISTINCT q) AS n_distinct, count(*) = 1 AS has_value, CASE WHEN count(*) = 1 THEN min(q) END AS single
FROM (SELECT l_orderkey, l_quantity AS q FROM lineitem) GROUP BY 1""")
def fp_existence(spark, d):
    q = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    big = F.transform("q", lambda x: x > 10)
    alone = C.take(C.where(F.col("q"), lambda x: C.has_value(F.col("q"))), 1)
    return q.select(
        "l_orderkey", C.all_true(big).alias("all_true"), C.any_true(big).alias("any_true"), C.all_false(big).alias("all_false"), C.any_false(big).alias("any_false"), F.size(C.distinct(F.col("q"))).cast("long").alias("n_distinct"), C.has_value(F.col("q")).alias("has_value"),
        C.one(C.single(alone)).alias("single"))


@query("""SELECT doc_id, octet_length(encode(t)) AS n, CASE WHEN contains(t, 'e') THEN octet_length(encode(t[:strpos(t, 'e') - 1])) ELSE -1 END AS first_e, CASE WHEN contains(t, 'e') THEN octet_length(encode(t[:length(t) - strpos(reverse(t), 'e')])) ELSE -1 END AS last_e,
length(t) AS chars, regexp_replace(t, '[aeiou]', '#', 'g') AS masked, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, t AS back, len(string_split(t, ' ')) AS parts, t AS decoded
FROM (SELECT doc_id, regexp_replace(left(coalesce(text, ''), 60), '\\s+', ' ', 'g') AS t FROM documents)""")
def fp_strings_more(spark, d):
    t = F.col("t")
    docs = T.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(60)), r"\s+", " ").alias("t"))
    return docs.select(
        "doc_id", S.length(t).cast("long").alias("n"), S.index_of(t, "e").cast("long").alias("first_e"), S.last_index_of(t, "e").cast("long").alias("last_e"), F.size(S.to_chars(t)).cast("long").alias("chars"), S.replace_matches(t, "[aeiou]", "#").alias("masked"),
        S.escape(t, "html").alias("html"), S.unescape(S.escape(t, "json"), "json").alias("back"), F.size(S.split(t, " ")).cast("long").alias("parts"), S.decode(S.encode(t, "base64"), "base64").alias("decoded"))


@query("SELECT doc_id, substring(t, strpos(t, 'e'), 3) AS part, trim(t) AS trimmed FROM (SELECT doc_id, regexp_replace(left(coalesce(text, ''), 60), '[^a-z ]', '', 'g') AS t FROM documents) WHERE contains(t, 'e')")
def fp_substring_at(spark, d):
    """Offsets of index_of serve substring, both in bytes."""
    t = F.col("t")
    docs = T.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(60)), "[^a-z ]", "").alias("t")).where(t.contains("e"))
    at = S.index_of(t, "e")
    part = F.try_validate_utf8(F.substring(t.cast("binary"), at + 1, F.lit(3)).cast("string"))
    return docs.select("doc_id", part.alias("part"), S.trim(t).alias("trimmed"))


@query("""SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(log(p_size) / log(2), 6) AS l, round_even(p_retailprice, 1) AS r, p_size - 0.5 AS low, p_size + 0.5 AS high, p_retailprice::DECIMAL(12, 2)::VARCHAR AS text, 2 AS digits FROM part WHERE p_size > 0""")
def fp_math_more(spark, d):
    n, price = F.col("p_size"), F.col("p_retailprice")
    text = S.to_string(price.cast("decimal(12,2)"))
    return T.table(spark, d, "part").where("p_size > 0").select(
        "p_partkey", F.round(S.exp(n / 10.0), 6).alias("e"), F.round(S.log(n, 2.0), 6).alias("l"), S.round_even(price, 1).alias("r"), S.low_boundary(n, 0).cast("decimal(11,1)").alias("low"),
        S.high_boundary(n, 0).cast("decimal(11,1)").alias("high"), text.alias("text"), S.decimal_precision(text).cast("int").alias("digits"))


_MIXED = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '4.50' WHEN 2 THEN '2020-02' WHEN 3 THEN 'true' WHEN 4 THEN 'T10:30' ELSE '2020-02-30' END AS t, o_orderkey % 6 AS k FROM orders"


@query(f"""SELECT o_orderkey, k = 0 AS whole, k IN (0, 1) AS number, k = 3 AS logical, k = 2 AS dated, k = 2 AS instant, k IN (0, 4) AS timed, k IN (0, 1) AS measured, true AS text,
CASE WHEN k < 2 THEN t::DOUBLE END AS number_value, CASE WHEN k = 2 THEN '2020-02-01' END AS date_value, CASE k WHEN 4 THEN '10:30' WHEN 0 THEN '12' END AS time_value, CASE k WHEN 4 THEN 4 WHEN 0 THEN 2 END AS time_digits FROM ({_MIXED})""")
def fp_converts(spark, d):
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, "12").when(k == 1, "4.50").when(k == 2, "2020-02").when(k == 3, "true").when(k == 4, "T10:30").otherwise("2020-02-30")
    return T.table(spark, d, "orders").select(
        "o_orderkey", S.converts_to_integer(t).alias("whole"), S.converts_to_decimal(t).alias("number"), S.converts_to_boolean(t).alias("logical"), S.converts_to_date(t).alias("dated"), S.converts_to_datetime(t).alias("instant"),
        S.converts_to_time(t).alias("timed"), S.converts_to_quantity(t).alias("measured"), S.converts_to_string(t).alias("text"), S.to_decimal(t).cast("double").alias("number_value"), F.date_format(S.to_date(t), "yyyy-MM-dd").alias("date_value"),
        S.to_time(t).alias("time_value"), S.time_precision(t).alias("time_digits"))


@query("""SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS from_zone, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS from_month, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS text FROM events""")
def fp_datetime(spark, d):
    ts = F.col("ts")
    zoned = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    show = "yyyy-MM-dd HH:mm:ss"
    return T.table(spark, d, "events").select(
        "event_id", F.date_format(S.to_datetime(zoned), show).alias("from_zone"), F.date_format(S.to_datetime(F.date_format(ts, "yyyy-MM")), show).alias("from_month"), S.to_string(ts, "datetime").alias("text"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS comparable, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN strftime(o_orderdate, '%Y-%m') < '1996-06' THEN -1 WHEN strftime(o_orderdate, '%Y-%m') > '1996-06' THEN 1 ELSE 0 END END AS cmp,
strftime(date_trunc(CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END, o_orderdate), '%Y-%m-%d') AS low,
strftime(CASE WHEN o_orderkey % 2 = 0 THEN last_day(o_orderdate) ELSE make_date(year(o_orderdate), 12, 31) END, '%Y-%m-%d') AS high, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 4 END AS digits,
date_diff('year', DATE '1960-01-01', o_orderdate::DATE)::INT AS age FROM orders""")
def fp_temporal(spark, d):
    o = F.col("o_orderdate")
    x = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(o, "yyyy-MM")).otherwise(F.date_format(o, "yyyy"))
    other = F.lit("1996-06")
    return T.table(spark, d, "orders").select(
        "o_orderkey", temporal.comparable(x, other).alias("comparable"), S.compare(x, other).alias("cmp"), F.date_format(temporal.low_date(x), "yyyy-MM-dd").alias("low"), F.date_format(temporal.high_date(x), "yyyy-MM-dd").alias("high"),
        S.date_precision(x).alias("digits"), temporal.age_at(F.lit("1960-01-01").cast("date"), o).alias("age"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'Integer' ELSE 'String' END AS kind, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS integers, event_type = 'error' AS is_integer, CASE WHEN event_type <> 'error' THEN event_type END AS as_text, 'Patient' AS whole, true AS conforms FROM events""")
def fp_types(spark, d):
    e = T.table(spark, d, "events")
    v = F.when(F.col("event_type") == "error", F.col("event_id").cast("variant")).otherwise(F.col("event_type").cast("variant"))
    e = e.select("event_id", F.array(v).alias("c"), F.parse_json(F.lit('{"resourceType":"Patient"}')).alias("p"))
    c = F.col("c")
    return e.select(
        "event_id", F.get(C.type_of(c), F.lit(0))["name"].alias("kind"), F.size(C.of_type(c, "Integer")).alias("integers"), C.is_type(c, "Integer").alias("is_integer"), C.one(C.as_type(c, "String")).cast("string").alias("as_text"), C.type_name(F.col("p")).alias("whole"),
        C.conforms_to(C.type_name(F.col("p")), "http://h.org/StructureDefinition/Patient").alias("conforms"))


@query("""SELECT 'c-' || c_custkey AS id, path, count(*) AS n FROM customer, (SELECT unnest(['resourceType', 'id', 'active', 'name[0]', 'name[0].family', 'name[0].given[0]', 'identifier[0]', 'identifier[0].system', 'identifier[0].value']) AS path) GROUP BY 1, 2""")
def fp_descendants(spark, d):
    docs = T.patient_documents(spark, d).select("id", F.parse_json("resource").alias("v"))
    return hierarchy.variant_descendants(docs, "id", "v").groupBy("id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, 3 AS levels, 'a.b.c' AS path FROM part")
def fp_repeat(spark, d):
    inner = F.array(F.struct(F.lit("c").alias("code"), F.array().cast("array<struct<code:string>>").alias("item")))
    middle = F.array(F.struct(F.lit("b").alias("code"), inner.alias("item")))
    p = T.table(spark, d, "part").select("p_partkey", F.array(F.struct(F.lit("a").alias("code"), middle.alias("item"))).alias("item"))
    level, codes = F.col("item"), []
    for _ in range(3):
        codes.append(C.select(level, lambda x: F.array(x["code"])))
        level = C.select(level, lambda x: x["item"]) if len(codes) < 3 else level
    all_codes = C.combine(C.combine(codes[0], codes[1]), codes[2])
    return p.select("p_partkey", F.size(C.distinct(all_codes)).alias("levels"), F.array_join(all_codes, ".").alias("path"))


@query("SELECT c_custkey, 'de' AS language, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS flags FROM customer")
def fp_extension(spark, d):
    flag = F.struct(F.lit("http://h.org/flag").alias("url"), F.lit("x").alias("value"))
    lang = F.struct(F.lit("http://h.org/language").alias("url"), F.lit("de").alias("value"))
    e = T.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array(lang, flag)).otherwise(F.array(lang)).alias("extension"))
    return e.select("c_custkey", C.one(C.extension(F.col("extension"), "http://h.org/language"))["value"].alias("language"), F.size(C.extension(F.col("extension"), "http://h.org/flag")).alias("flags"))


@query("SELECT o_orderkey, c_name AS family FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fp_resolve(spark, d):
    refs = T.table(spark, d, "orders").select("o_orderkey", F.lit("Patient").alias("target_type"), T.rid("c", "o_custkey").alias("target_id"))
    people = T.table(spark, d, "customer").select(F.lit("Patient").alias("resource_type"), T.rid("c", "c_custkey").alias("resource_id"), F.col("c_name").alias("family"))
    return search.resolve(refs, people).select("o_orderkey", "family")


# ---- search -------------------------------------------------------------------------------------


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_custkey IN (1, 5, 9)")
def search_id(spark, d):
    return _ids(search.keys(search.rows_of(T.string_index(spark, d), "Patient", "name"), search.id_is(["c-1", "c-5", "c-9"])))


for _p, _sql in {"eq": "u >= l AND u < h", "ne": "NOT (u >= l AND u < h)", "gt": "u >= h", "lt": "u < l", "ge": "u >= l", "le": "u < h", "po": "u >= l AND u < h", "ap": "u >= l - INTERVAL 267840 SECOND AND u < h + INTERVAL 267840 SECOND"}.items():
    query(f"SELECT 'o-' || o_orderkey AS resource_id FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 3) * INTERVAL 1 DAY AS u, TIMESTAMP '1998-03-01' AS l, TIMESTAMP '1998-04-01' AS h FROM orders) WHERE {_sql}", f"search_last_updated_{_p}")(
        lambda spark, d, p=_p: T.encounters(spark, d).where("is_current").where(search.last_updated_is(p, "1998-03")).select(F.col("id").alias("resource_id")))


def _segments(spark):
    return spark.createDataFrame([("urn:segment", "Building"), ("urn:segment", "MACHINERY"), ("urn:other", "FURNITURE")], "system string, code string")


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def search_token_in(spark, d):
    return _ids(search.token_in(search.rows_of(T.token_index(spark, d), "Patient", "segment"), _segments(spark)))


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def search_token_not_in(spark, d):
    return _ids(search.token_not_in(search.rows_of(T.token_index(spark, d), "Patient", "segment"), _segments(spark)))


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_custkey IN (3, 12)")
def search_token_of_type(spark, d):
    return _ids(search.keys(search.rows_of(T.identifier_index(spark, d), "Patient", "identifier"), search.identifier_is(["urn:identifier-type|mr|00000003", "|MR|00000012"])))


@query("SELECT 'p-' || p_partkey AS resource_id FROM part WHERE lower(p_type) LIKE 'pro%' OR lower(p_brand) LIKE 'brand#2%'")
def search_token_code_text(spark, d):
    ix = T.token_index(spark, d)
    found = search.hits(search.rows_of(ix, "Medication", "type"), search.token_is(["pro"], "code-text")).unionByName(search.hits(search.rows_of(ix, "Medication", "brand"), search.token_is(["brand#2"], "code-text")))
    return _ids(found.distinct())


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%'")
def search_token_text_advanced(spark, d):
    return _ids(search.keys(search.rows_of(T.token_index(spark, d), "Encounter", "priority"), search.token_is(["urgent"], "text-advanced")))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE o_custkey IN (5, 8)")
def search_reference_identifier(spark, d):
    return _ids(search.keys(search.rows_of(T.reference_identifier_index(spark, d), "Encounter", "subject"), search.identifier_is(["urn:mrn|00000005", "00000008"])))


@query("SELECT 'p-' || p_partkey AS resource_id FROM part WHERE p_partkey % 4 = 0 AND p_size = 7 OR p_partkey % 4 = 1 AND p_size IN (7, 9) OR p_partkey % 4 = 2 AND p_size = 12 OR p_partkey % 4 = 3 AND p_size = 4")
def search_reference_shapes(spark, d):
    asked = ["Substance/7", "https://h.org/r4/Substance/9", "http://h.org/KnowledgeBase|1.12", "#c4"]
    return _ids(search.keys(T.literal_index(spark, d), search.reference_is(asked)))


@query("SELECT 'p-' || p_partkey AS resource_id FROM part WHERE p_partkey % 4 = 0 AND p_size = 7")
def search_reference_version(spark, d):
    return _ids(search.keys(T.literal_index(spark, d), search.reference_is(["Substance/7/_history/2"])))


for _m, _sql in {"above": "p_size >= 9", "below": "p_size <= 9"}.items():
    query(f"SELECT 'p-' || p_partkey AS resource_id FROM part WHERE p_partkey % 4 = 2 AND {_sql}", f"search_canonical_{_m}")(
        lambda spark, d, m=_m: _ids(search.keys(T.literal_index(spark, d), search.canonical_is("http://h.org/KnowledgeBase|1.9", m))))


@query("SELECT 'doc-' || doc_id AS resource_id FROM labels WHERE quality = 0")
def search_list(spark, d):
    edges = T.table(spark, d, "labels").select(F.lit("List").alias("collection_type"), T.rid("l", "quality").alias("collection_id"), F.lit("DocumentReference").alias("member_type"), T.rid("doc", "doc_id").alias("member_id"))
    return _ids(search.on_list(edges, "l-0"))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE o_custkey IN (SELECT doc_id FROM labels WHERE quality = 1)")
def search_reference_list(spark, d):
    edges = T.table(spark, d, "labels").select(F.lit("List").alias("collection_type"), T.rid("l", "quality").alias("collection_id"), F.lit("Patient").alias("member_type"), T.rid("c", "doc_id").alias("member_id"))
    return _ids(search.chained(T.reference_index(spark, d), "Encounter", "subject", "Patient", search.on_list(edges, "l-1")))


@query("SELECT 'doc-' || doc_id AS resource_id FROM documents WHERE lang = 'en' AND n_chars > 1000 AND doc_id % 7 = 0 AND doc_id % 2 = 0")
def search_metadata(spark, d):
    ix = T.metadata_index(spark, d)
    kind = "DocumentReference"
    base = search.keys(search.rows_of(ix, kind, "_language"), search.token_is(["en"]))
    for found in (search.hits(search.rows_of(ix, kind, "_tag"), search.token_is(["urn:tag|long"])), search.hits(search.rows_of(ix, kind, "_security"), search.token_is(["r"])), search.hits(search.rows_of(ix, kind, "_profile"), search.uri_is(["http://h.org/profiles/note"]))):
        base = search.only(base, found)
    return _ids(base)


@query("SELECT 'doc-' || doc_id AS resource_id FROM documents WHERE starts_with('https://' || source || '/feed', 'https://' || (SELECT min(source) FROM documents) || '/') ")
def search_source_below(spark, d):
    ix = search.rows_of(T.metadata_index(spark, d), "DocumentReference", "_source")
    least = T.table(spark, d, "documents").agg(F.min("source")).first()[0]
    return _ids(search.keys(ix, search.uri_is([f"https://{least}/"], "below")))


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_custkey = 7 OR c_name LIKE '%19'")
def search_string_eq_ew(spark, d):
    ix = search.rows_of(T.string_index(spark, d), "Patient", "name")
    return _ids(search.keys(ix, search.string_is(["customer#000000007"], "eq") | search.string_is(["19"], "ew")))


@query("SELECT 'p-' || p_partkey AS resource_id FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'ring')")
def search_string_text(spark, d):
    return _ids(search.keys(search.rows_of(T.string_index(spark, d), "Medication", "name"), search.string_is(["ring"], "text")))


@query("SELECT 'doc-' || doc_id AS resource_id FROM documents WHERE doc_id % 7 <> 0")
def search_missing_true(spark, d):
    ix = T.metadata_index(spark, d)
    return _ids(search.missing(search.rows_of(ix, "DocumentReference", "_language").select(*T.KEY), ix, "DocumentReference", "_security"))


@query("SELECT 'doc-' || doc_id AS resource_id FROM documents WHERE doc_id % 7 = 0")
def search_missing_false(spark, d):
    ix = T.metadata_index(spark, d)
    return _ids(search.missing(search.rows_of(ix, "DocumentReference", "_language").select(*T.KEY), ix, "DocumentReference", "_security", absent=False))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def chain_by_name(spark, d):
    target = search.chain_target("subject")
    found = search.hits(search.rows_of(T.token_index(spark, d), target, "segment"), search.token_is(["building"]))
    return _ids(search.chained(T.reference_index(spark, d), "Encounter", "subject", target, found))


@query("SELECT 'n-' || n_nationkey AS resource_id, 'r-' || n_regionkey AS target_id FROM nation WHERE n_regionkey <= 2 AND n_nationkey <= 12")
def edges_within_set(spark, d):
    n, r = T.table(spark, d, "nation").where("n_nationkey <= 12"), T.table(spark, d, "region").where("r_regionkey <= 2")
    page = n.select(F.lit("Location").alias("resource_type"), T.rid("n", "n_nationkey").alias("resource_id")).unionByName(r.select(F.lit("Location").alias("resource_type"), T.rid("r", "r_regionkey").alias("resource_id")))
    return search.edges_within(search.rows_of(T.reference_index(spark, d), "Location", "partof"), page).select("resource_id", "target_id")


@query("SELECT 'in' AS way, 'n-' || n_nationkey AS other FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'out', 'r-' || n_regionkey FROM nation WHERE n_nationkey = 3")
def edges_of_one(spark, d):
    refs = T.reference_index(spark, d).where("resource_type = 'Location'")
    came = search.edges_of(refs, "Location", "r-1", incoming=True).select(F.lit("in").alias("way"), F.col("resource_id").alias("other"))
    return came.unionByName(search.edges_of(refs, "Location", "n-3").select(F.lit("out").alias("way"), F.col("target_id").alias("other")))


@query("SELECT 'p-' || p_partkey AS resource_id FROM part ORDER BY p_size DESC NULLS LAST, p_name ASC NULLS LAST, resource_id LIMIT 40")
def sort_by_two(spark, d):
    base = search.rows_of(T.string_index(spark, d), "Medication", "name").select(*T.KEY)
    size, name = search.sort_key(T.number_index(spark, d), "Medication", "size", "value"), search.sort_key(T.string_index(spark, d), "Medication", "name", "value")
    return _ids(search.sorted_by(base, [(size, True), (name, False)], search.checked(count=40)["count"]))


@query("SELECT id FROM (SELECT 'o-' || o_orderkey AS id, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01' ORDER BY o_orderdate, id LIMIT 20)")
def page_before(spark, d):
    rows = T.table(spark, d, "orders").select(T.rid("o", "o_orderkey").alias("id"), F.col("o_orderdate").alias("last_updated"))
    return search.keyset_page(rows, (F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")), F.lit("p")), 20, back=True).select("id")


@query("SELECT id FROM (SELECT 'o-' || o_orderkey AS id FROM orders ORDER BY o_orderdate, id LIMIT 15)")
def page_last(spark, d):
    rows = T.table(spark, d, "orders").select(T.rid("o", "o_orderkey").alias("id"), F.col("o_orderdate").alias("last_updated"))
    return search.keyset_page(rows, None, 15, back=True).select("id")


# ---- documents and versions ---------------------------------------------------------------------


@query("SELECT 'o-' || o_orderkey AS id, (o_orderkey % 3 + 1)::INT AS version_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7 AND o_orderkey % 17 <> 0")
def read_current(spark, d):
    return history.current(T.encounters(spark, d)).where("id = 'o-7'").select("id", "version_id", "status")


@query("SELECT 'o-' || o_orderkey AS id, 1::INT AS version_id, 'O' AS status FROM orders WHERE o_orderkey = 8")
def read_past_version(spark, d):
    return history.read_version(T.encounters(spark, d), "Encounter", "o-8", 1).select("id", "version_id", "status")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id, status FROM v WHERE is_current AND NOT deleted AND o_orderkey % 10 <> 0 UNION ALL SELECT 'o-' || o_orderkey, (o_orderkey % 3 + 2)::INT, 'U' FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 17 <> 0 UNION ALL SELECT id, version_id::INT, status FROM v WHERE false")
def update_guarded(spark, d):
    """Updates of every tenth encounter that name the version they saw; those of deleted ones fall away."""
    v = T.encounters(spark, d)
    asked = T.table(spark, d, "orders").where("o_orderkey % 10 = 0").select(
        F.lit("Encounter").alias("resource_type"), T.rid("o", "o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("expected_version"), F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")).alias("last_updated"), F.lit("U").alias("status"), F.lit(False).alias("deleted"), F.col("o_totalprice").alias("total"))
    new = history.appended(v, history.guarded(v, asked).drop("expected_version"))
    return history.newest(v.drop("is_current").unionByName(new)).select("id", "version_id", "status")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id FROM v WHERE is_current AND NOT deleted AND o_orderkey % 4 <> 0")
def delete_soft(spark, d):
    v = T.encounters(spark, d)
    gone = T.table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.lit("Encounter").alias("resource_type"), T.rid("o", "o_orderkey").alias("id"), F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")).alias("last_updated"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("deleted"), F.lit(0.0).alias("total"))
    return history.current(history.append_versions(v, gone)).select("id", "version_id")


@query(_VERSIONS + "SELECT id, count(*) AS versions FROM v WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def delete_hard(spark, d):
    keys = T.table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.lit("Encounter").alias("resource_type"), T.rid("o", "o_orderkey").alias("id"))
    return history.purge(T.encounters(spark, d), keys).groupBy("id").agg(F.count(F.lit(1)).alias("versions"))


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id FROM v WHERE NOT (version_id = 1 AND NOT is_current)")
def delete_hard_version(spark, d):
    v = T.encounters(spark, d)
    return history.purge_version(v, v.where("version_id = 1").select("resource_type", "id", "version_id")).select("id", "version_id")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id, is_current FROM v")
def history_replay(spark, d):
    v = T.encounters(spark, d)
    return history.replay(v.where("version_id <> 1"), v.drop("is_current")).select("id", "version_id", "is_current")


@query(_VERSIONS + "SELECT version_id::INT AS version_id, CASE WHEN deleted THEN 'DELETE' WHEN version_id = 1 THEN 'POST' ELSE 'PUT' END AS method FROM v WHERE o_orderkey = 5")
def history_instance(spark, d):
    return history.history(T.encounters(spark, d), id="o-5").select("version_id", "method")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id FROM v WHERE last_updated >= TIMESTAMP '1999-06-01' ORDER BY last_updated DESC, id DESC, version_id DESC LIMIT 50")
def history_system(spark, d):
    return history.history(T.encounters(spark, d), F.to_timestamp_ntz(F.lit("1999-06-01 00:00:00")), 50).select("id", "version_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Patient/c-' || o_custkey WHEN o_orderkey % 3 = 1 AND o_custkey <= (SELECT max(c_custkey) FROM customer) THEN 'Patient/c-' || o_custkey ELSE 'Patient?identifier=urn:mrn|none' END AS subject,
CASE o_orderkey % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'resolved' ELSE 'none' END AS outcome FROM orders""")
def conditional_references(spark, d):
    k = F.col("o_orderkey") % 3
    subject = F.when(k == 0, F.concat(F.lit("Patient/"), T.rid("c", "o_custkey"))).when(k == 1, F.concat(F.lit("Patient?identifier=urn:mrn|"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))).otherwise("Patient?identifier=urn:mrn|none")
    return shape.conditional_references(T.table(spark, d, "orders").select("o_orderkey", subject.alias("subject")), "subject", T.identifier_index(spark, d)).select("o_orderkey", "subject", "outcome")


@query("SELECT 'c-' || c_custkey AS id, 'x' AS family, lower(c_mktsegment) AS given, c_name AS old, true AS gone FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'c-' || c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_acctbal < 0")
def patch_json(spark, d):
    steps = [{"op": "test", "path": "/active", "value": True}, {"op": "copy", "from": "/name/0/family", "path": "/old"}, {"op": "replace", "path": "/name/0/family", "value": "x"}, {"op": "remove", "path": "/identifier"}, {"op": "add", "path": "/name/-", "value": {"family": "y"}}]
    v = shape.json_patch(T.patient_documents(spark, d), steps).select("id", F.parse_json("resource").alias("v"))

    def at(path: str):
        return F.try_variant_get("v", path, "string")

    return v.select("id", at("$.name[0].family").alias("family"), at("$.name[0].given[0]").alias("given"), at("$.old").alias("old"), F.when(F.col("v").isNotNull(), at("$.identifier").isNull()).alias("gone"))


@query("SELECT 'c-' || c_custkey AS id, '<Patient><id>c-' || c_custkey || '</id><active>' || (c_acctbal >= 0) || '</active></Patient>' AS xml FROM customer")
def documents_as_xml(spark, d):
    return T.documents_to_xml(T.patient_documents(spark, d), "id string, active boolean", "Patient").select("id", "xml")


@query("SELECT 'Patient' AS resource_type, CASE WHEN c_custkey % 5 = 0 THEN 'created' WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS n FROM customer GROUP BY 1, 2")
def package_install(spark, d):
    docs = T.patient_documents(spark, d).withColumn("resource_type", F.lit("Patient"))
    k = F.split("id", "-")[1].cast("long")
    known = docs.where(k % 5 != 0).withColumn("resource", F.when(k % 2 == 0, F.lit("{}")).otherwise(F.col("resource")))
    return shape.install(docs, known)


# ---- extraction ---------------------------------------------------------------------------------

_OBSERVATION = "struct<value:string,system:string,code:string,unit:string>"


@query("SELECT 'e-' || event_id AS resource_id, round(value, 6) AS value, 'http://unitsofmeasure.org' AS system, CASE WHEN event_type = 'purchase' THEN 'mg' ELSE 'g' END AS code FROM events WHERE event_id % 9 <> 0")
def extract_quantities(spark, d):
    e = T.table(spark, d, "events")
    unit = F.when(F.col("event_type") == "purchase", "mg").otherwise("g")
    value = F.when(F.col("event_id") % 9 != 0, F.col("value").cast("string"))
    docs = e.select(T.rid("e", "event_id").alias("id"), F.array(F.struct(value.alias("value"), F.lit("http://unitsofmeasure.org").alias("system"), unit.alias("code"), unit.alias("unit"))).cast(f"array<{_OBSERVATION}>").alias("q"))
    rows = extract.routed(docs, F.col("id"), "Observation", [("value-quantity", "quantity", F.col("q"))])["quantity"]
    return rows.select("resource_id", F.round(F.col("value").cast("double"), 6).alias("value"), "system", "code")


@query("SELECT 'p-' || p_partkey AS resource_id, p_size::DOUBLE AS value FROM part WHERE p_partkey % 3 <> 0")
def extract_numbers(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, F.lit("none")).otherwise(F.col("p_size").cast("string"))
    docs = T.table(spark, d, "part").select(T.rid("p", "p_partkey").alias("id"), F.array(x).alias("x"))
    return extract.index_rows(docs, F.col("id"), "Medication", "size", extract.number_values(F.col("x"))).select("resource_id", F.col("value").cast("double").alias("value"))


@query("SELECT 'c-' || c_custkey AS resource_id, 'urn:identifier-type' AS type_system, 'mr' AS type_code_ci, lpad(c_custkey::VARCHAR, 8, '0') AS value FROM customer WHERE c_custkey % 2 = 0")
def extract_identifier_types(spark, d):
    coding = F.array(F.struct(F.lit("urn:identifier-type").alias("system"), F.lit("MR").alias("code")))
    kind = F.struct(F.when(F.col("c_custkey") % 2 == 0, coding).alias("coding"))
    i = F.array(F.struct(kind.alias("type"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("value")))
    docs = T.table(spark, d, "customer").select(T.rid("c", "c_custkey").alias("id"), i.alias("i"))
    return extract.index_rows(docs, F.col("id"), "Patient", "identifier", extract.identifier_types(F.col("i"))).select("resource_id", "type_system", "type_code_ci", "value")


@query("""SELECT 'c-' || c_custkey AS resource_id, 'urn:segment' AS system, c_mktsegment AS code FROM customer UNION ALL SELECT 'c-' || c_custkey, 'home', '+49' || c_custkey FROM customer UNION ALL SELECT 'c-' || c_custkey, NULL, CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END FROM customer""")
def extract_tokens(spark, d):
    concept = F.array(F.struct(F.array(F.struct(F.lit("urn:segment").alias("system"), F.col("c_mktsegment").alias("code"))).alias("coding")))
    contact = F.array(F.struct(F.lit("home").alias("use"), F.concat(F.lit("+49"), F.col("c_custkey").cast("string")).alias("value")))
    docs = T.table(spark, d, "customer").select(T.rid("c", "c_custkey").alias("id"), concept.alias("concept"), contact.alias("contact"), F.array(F.col("c_acctbal") >= 0).alias("active"))
    tokens = C.combine(C.combine(extract.concept_tokens(F.col("concept")), extract.contact_tokens(F.col("contact"))), extract.scalar_tokens(F.col("active")))
    return extract.index_rows(docs, F.col("id"), "Patient", "any", tokens).select("resource_id", "system", "code")


@query("""SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS low, CASE WHEN o_orderkey % 2 = 0 THEN '9999-01-01' ELSE strftime(date_trunc('day', o_orderdate) + INTERVAL 4 DAY, '%Y-%m-%d') END AS high FROM orders""")
def extract_periods(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderkey") % 2 != 0, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 3), "yyyy-MM-dd"))
    o = T.table(spark, d, "orders").select("o_orderkey", F.array(F.struct(day.alias("start"), end.alias("end"))).alias("p"))
    r = o.select("o_orderkey", F.explode(extract.date_ranges(F.array().cast("array<string>"), F.col("p"))).alias("r"))
    return r.select("o_orderkey", F.date_format("r.start_date", "yyyy-MM-dd").alias("low"), F.date_format("r.end_date", "yyyy-MM-dd").alias("high"))


@query("SELECT 'o-' || o_orderkey AS resource_id, 'urn:mrn' AS system, lpad(o_custkey::VARCHAR, 8, '0') AS code FROM orders")
def extract_reference_identifiers(spark, d):
    i = F.array(F.struct(F.lit("urn:mrn").alias("system"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("value")))
    docs = T.table(spark, d, "orders").select(T.rid("o", "o_orderkey").alias("id"), i.alias("i"))
    return extract.index_rows(docs, F.col("id"), "Encounter", "subject", extract.identifier_tokens(F.col("i"))).select("resource_id", "system", "code")


@query("SELECT p_partkey, 'Part ' || p_name || CASE WHEN p_brand <> p_name THEN ' ' || p_brand ELSE '' END AS content FROM part")
def extract_all_text(spark, d):
    html = F.concat(F.lit("<div><b>Part</b> "), F.col("p_name"), F.lit("</div>"))
    return T.table(spark, d, "part").select("p_partkey", extract.all_text(html, F.col("p_brand"), F.col("p_brand")).alias("content"))


@query("SELECT DISTINCT p_brand AS code, 'product' AS parent FROM part UNION SELECT DISTINCT p_brand || '/' || p_type, p_brand FROM part UNION SELECT 'product', NULL")
def code_system_load(spark, d):
    leaf = T.table(spark, d, "part").select("p_brand", "p_type").distinct()
    inner = F.struct(F.concat_ws("/", "p_brand", "p_type").alias("code"), F.col("p_type").alias("display"))
    brands = leaf.groupBy("p_brand").agg(F.collect_list(inner).alias("concept")).select(F.struct(F.col("p_brand").alias("code"), F.col("p_brand").alias("display"), "concept").alias("c"))
    root = brands.agg(F.array(F.struct(F.lit("product").alias("code"), F.lit("Product").alias("display"), F.collect_list("c").alias("concept"))).alias("concept")).withColumn("url", F.lit("urn:product"))
    return extract.code_system_concepts(root, 3).select("code", "parent")


@query("SELECT DISTINCT 'urn:status' AS source_system, o_orderstatus AS source_code, 'urn:encounter' AS target_system, lower(o_orderstatus) AS target_code, 'equal' AS equivalence FROM orders")
def concept_map_load(spark, d):
    codes = T.table(spark, d, "orders").select("o_orderstatus").distinct()
    target = F.array(F.struct(F.lower("o_orderstatus").alias("code"), F.lit("equal").alias("equivalence")))
    element = codes.agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("code"), target.alias("target"))).alias("element"))
    maps = element.select(F.array(F.struct(F.lit("urn:status").alias("source"), F.lit("urn:encounter").alias("target"), "element")).alias("group"))
    return extract.concept_map_rows(maps)


_DEFINITION = [("Patient", [("Encounter", ["subject"]), ("Observation", ["subject", "performer"])]), ("Location", [("Patient", ["address"])])]


@query("SELECT * FROM (VALUES ('Patient', 'Encounter', 'subject'), ('Patient', 'Observation', 'subject'), ('Patient', 'Observation', 'performer'), ('Location', 'Patient', 'address')) t(compartment, resource_type, parameter_name)")
def compartment_load(spark, d):
    return extract.compartments(spark.createDataFrame(_DEFINITION, "code string, resource array<struct<code:string,param:array<string>>>"))


@query("SELECT 'code' AS code, 'Patient' AS base, 'token' AS type UNION ALL SELECT 'text', 'DomainResource', 'string' UNION ALL SELECT '_id', 'Resource', 'token'")
def parameter_resolution(spark, d):
    rows = [("code", "Patient", "token"), ("code", "Resource", "string"), ("text", "DomainResource", "string"), ("text", "Resource", "token"), ("_id", "Resource", "token"), ("date", "Encounter", "date")]
    return extract.resolved_parameters(spark.createDataFrame(rows, "code string, base string, type string"), "Patient").select("code", "base", "type")


# ---- terminology, units, profiles ---------------------------------------------------------------


def _with_properties(spark, d):
    p = T.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.collect_set(F.struct(F.lit("size").alias("code"), F.col("p_size").cast("string").alias("value"))).alias("properties"))
    return p.select(F.lit("urn:product").alias("system"), F.concat_ws("/", "p_brand", "p_type").alias("code"), F.lower("p_type").alias("display"), F.lit(True).alias("active"), "properties")


@query("SELECT DISTINCT p_brand || '/' || p_type AS code FROM part WHERE p_size IN (3, 4) UNION SELECT DISTINCT p_brand || '/' || p_type FROM part WHERE p_brand = 'Brand#3'")
def valueset_nested(spark, d):
    sets = {"outer": [{"value_set": "sized"}, {"value_set": "outer"}, {"system": "urn:product", "where": "code LIKE 'Brand#3/%'"}], "sized": [{"system": "urn:product", "property": {"size": ["3", "4"]}}]}
    return terminology.expand(_with_properties(spark, d), _tree(spark, d), terminology.composed(sets, "outer")).select("code")


@query("SELECT DISTINCT p_brand || '/' || p_type AS code, 'designation' AS kind, 'de' AS name, upper(p_type) AS value FROM part WHERE p_brand = 'Brand#2' UNION SELECT DISTINCT p_brand || '/' || p_type, 'property', 'size', p_size::VARCHAR FROM part WHERE p_brand = 'Brand#2'")
def lookup_designations(spark, d):
    c = _with_properties(spark, d)
    properties = c.select("system", "code", F.explode("properties").alias("p")).select("system", "code", F.col("p.code").alias("property"), "p.value")
    words = c.select("system", "code", F.lit("de").alias("language"), F.upper("display").alias("value"))
    codes = [r.code for r in c.where("code LIKE 'Brand#2/%'").select("code").distinct().collect()]
    parts = [terminology.lookup_all(c, properties, words, "urn:product", x).select("code", "kind", "name", "value") for x in codes]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT 'urn:product' AS system, count(DISTINCT p_brand || '/' || p_type) AS concepts, count(DISTINCT p_brand || '/' || p_type) AS active FROM part")
def terminology_summary(spark, d):
    return terminology.summary(_with_properties(spark, d))


@query("SELECT DISTINCT p_brand || '/' || p_type AS descendant, p_brand AS ancestor, 3 AS version FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def closure_of_codes(spark, d):
    p = T.table(spark, d, "part").where("p_brand IN ('Brand#1', 'Brand#2')")
    codes = p.select(F.concat_ws("/", "p_brand", "p_type").alias("code")).unionByName(p.select(F.col("p_brand").alias("code")))
    return terminology.closure_table(_tree(spark, d), codes, 3)


@query("SELECT event_type AS code, true AS convertible, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1 UNION ALL SELECT event_type, false, count(*) FROM events WHERE event_type = 'error' GROUP BY 1")
def units_convertible(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_type").alias("code"), F.when(F.col("event_type") == "error", "cm").otherwise("mg").alias("unit"))
    return units.convertible(e, "kg").groupBy("code", "convertible").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'c-' || c_custkey AS id, 'identifier-unknown' AS rule FROM customer")
def unknown_elements(spark, d):
    return rules.unknown_elements(T.patient_documents(spark, d), "id", "resource", ["resourceType", "id", "name", "active"]).select("id", "rule")


@query("""SELECT l_orderkey AS id, rule, 'error' AS severity FROM (SELECT l_orderkey, unnest(list_filter(['lines-cardinality' , 'lines:returned'], lambda r: CASE r WHEN 'lines-cardinality' THEN n > 5 ELSE returned > 2 END)) AS rule
FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1))""")
def profile_check(spark, d):
    g = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag")).alias("lines"))
    checks = [rules.cardinality("lines", 1, 5), rules.slice_count("lines", "returned", lambda x: x["l_returnflag"] == "R", 0, 2)]
    return rules.issues(g, "l_orderkey", checks).select("id", "rule", "severity")


@query("SELECT * FROM (VALUES ('Patient', 0, 1, NULL), ('Patient.name', 1, 5, 'required'), ('Patient.active', 0, 1, NULL)) t(path, min, max, binding)")
def snapshot_merge(spark, d):
    kind = "path string, min int, max int, types array<string>, binding string"
    base = spark.createDataFrame([("Patient", 0, 1, None, None), ("Patient.name", 0, 5, ["HumanName"], None), ("Patient.active", 0, 1, ["boolean"], None)], kind)
    change = spark.createDataFrame([("Patient.name", 1, 9, ["HumanName"], "required")], kind)
    merged = rules.merged_snapshot(base, change)
    return merged.select("path", "min", "max", "binding")


@query("SELECT 'Patient.name' AS path, 1 AS min, 'required' AS binding")
def snapshot_differential(spark, d):
    kind = "path string, min int, max int, types array<string>, binding string"
    base = spark.createDataFrame([("Patient.name", 0, 5, ["HumanName"], None), ("Patient.active", 0, 1, ["boolean"], None)], kind)
    snap = spark.createDataFrame([("Patient.name", 1, 5, ["HumanName"], "required"), ("Patient.active", 0, 1, ["boolean"], None)], kind)
    return rules.differential(base, snap).select("path", "min", "binding")


@query("SELECT * FROM (VALUES ('Patient.name'), ('Patient.contact'), ('Patient.name.family'), ('Patient.name.period'), ('Patient.contact.name'), ('Patient.name.period.start'), ('Patient.contact.name.family'), ('Patient.contact.name.period')) t(path)")
def snapshot_deep(spark, d):
    rows = [("Patient", "Patient.name", "HumanName"), ("Patient", "Patient.contact", "Contact"), ("HumanName", "HumanName.family", "string"), ("HumanName", "HumanName.period", "Period"), ("Period", "Period.start", "dateTime"), ("Contact", "Contact.name", "HumanName")]
    return rules.deep_snapshot(spark.createDataFrame(rows, "type string, path string, of string"), "Patient", 2).select("path")


# ---- administration -----------------------------------------------------------------------------


@query("""SELECT 'Patient' AS resource_type, 'segment' AS parameter_name, (SELECT count(*) FROM customer) AS indexed, (SELECT count(*) FROM customer) AS "rows", (SELECT count(*) FROM customer) AS total, 100.0::DOUBLE AS percent
UNION ALL SELECT 'Patient', 'name', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), 100.0 UNION ALL SELECT 'Patient', 'nothing', 0, 0, (SELECT count(*) FROM customer), 0.0
UNION ALL SELECT 'Medication', 'size', (SELECT count(*) FROM part), (SELECT count(*) FROM part), 0, 0.0""")
def indexing_status(spark, d):
    wanted = spark.createDataFrame([("Patient", "segment"), ("Patient", "name"), ("Patient", "nothing"), ("Medication", "size")], "resource_type string, parameter_name string")
    totals = T.table(spark, d, "customer").agg(F.lit("Patient").alias("resource_type"), F.count(F.lit(1)).alias("total")).select("resource_type", "total")
    indexes = {"string": T.string_index(spark, d), "token": T.token_index(spark, d), "number": T.number_index(spark, d), "reference": T.reference_index(spark, d).where("resource_type IN ('Patient', 'Medication')")}
    return reports.indexing_status(indexes, totals, wanted)


@query("SELECT 'string' AS index, (SELECT count(*) FROM customer) AS entries, 0 AS collisions UNION ALL SELECT 'number', (SELECT count(*) FROM part), 0")
def hash_collisions(spark, d):
    return reports.hash_collisions({"string": (search.rows_of(T.string_index(spark, d), "Patient", "name"), [*T.KEY, "value"]), "number": (search.rows_of(T.number_index(spark, d), "Medication", "size"), [*T.KEY, "value"])})


@query("SELECT 'orders' AS name, count(*) AS \"rows\" FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'pages', count(*) FROM pages")
def table_row_counts(spark, d):
    return reports.row_counts({n: T.table(spark, d, n) for n in ("orders", "part", "pages")})


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND contains(lower(props), '1') ORDER BY ts DESC, event_id LIMIT 25 OFFSET 5")
def list_audit_events(spark, d):
    e = T.table(spark, d, "events").withColumn("back", -F.unix_micros(F.col("ts").cast("timestamp")))
    return reports.listing(e, ["back", "event_id"], {"event_type": "error"}, "1", ["props"], 5, 25).select("event_id", "user_id")


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) = 4 ORDER BY conv_id LIMIT 30")
def list_bundles(spark, d):
    b = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return reports.listing(b, ["conv_id"], {"turns": 4}, count=30)


@query("SELECT conv_id, count(*) AS entries, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def bundle_detail(spark, d):
    c = T.table(spark, d, "conversations")
    return reports.bundle_detail(c.select("conv_id").distinct(), c, "conv_id", "turn", "role").select("conv_id", "entries", F.array_join("role", ">").alias("roles"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 10 OFFSET 5")
def list_parameters(spark, d):
    return reports.listing(T.table(spark, d, "part"), ["p_partkey"], None, "RING", ["p_name", "p_type"], 5, 10).select("p_partkey", "p_name")


@query("SELECT 'Patient' AS compartment, 'Encounter' AS resource_type UNION ALL SELECT 'Patient', 'Observation' UNION ALL SELECT 'Patient', 'Observation' UNION ALL SELECT 'Location', 'Patient'")
def list_compartments(spark, d):
    rows = extract.compartments(spark.createDataFrame(_DEFINITION, "code string, resource array<struct<code:string,param:array<string>>>"))
    return reports.listing(rows, ["compartment", "resource_type", "parameter_name"]).select("compartment", "resource_type")


@query("SELECT * FROM (VALUES ('Patient'), ('Organization'), ('Medication'), ('Location')) t(resource_type)")
def supported_types(spark, d):
    return T.string_index(spark, d).select("resource_type").distinct()


@query("SELECT 'http://h.org/sp/' || n_nationkey AS url, n_nationkey <> 3 AS active FROM nation")
def toggle_parameter(spark, d):
    p = T.table(spark, d, "nation").select(F.concat(F.lit("http://h.org/sp/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit(True).alias("active"))
    return shape.toggled(p, "http://h.org/sp/3", False)


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS done, round(avg(value), 6) AS mean FROM events")
def queue_health(spark, d):
    return reports.queue_stats(T.table(spark, d, "events"), "event_type", {"failed": ["error"], "done": ["purchase"]}, "value")
