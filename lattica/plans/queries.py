"""Queries of the document engine over the supplied tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import collections as C
from lattica.functions import scalars as S
from lattica.operators import hierarchy, history, reports, rules, search, terminology, units
from lattica.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def _ids(df: DataFrame) -> DataFrame:
    return df.select("resource_id")


# ---- predicates ---------------------------------------------------------------------------------

for _name, _values, _modifier, _sql in [
    ("search_string_prefix", ["customer#00000001"], "", "lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) LIKE 'customer00000001%'"),
    ("search_string_exact", ["Customer#000000007", "customer#000000008"], "exact", "c_name IN ('Customer#000000007', 'customer#000000008')"),
    ("search_string_contains", ["0017"], "contains", "lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) LIKE '%0017%'"),
]:
    query(f"SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE {_sql}", _name)(
        lambda spark, d, v=_values, m=_modifier: _ids(search.keys(search.rows_of(T.string_index(spark, d), "Patient", "name"), search.string_is(v, m))))

for _name, _values, _modifier, _sql in [
    ("search_token_code", ["building", "MACHINERY"], "", "lower(c_mktsegment) IN ('building', 'machinery')"),
    ("search_token_system_code", ["urn:segment|Furniture"], "", "lower(c_mktsegment) = 'furniture'"),
    ("search_token_above", ["ma"], "above", "lower(c_mktsegment) LIKE 'ma%'"),
    ("search_token_text", ["house"], "text", "lower(c_mktsegment) LIKE 'house%'"),
]:
    query(f"SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE {_sql}", _name)(
        lambda spark, d, v=_values, m=_modifier: _ids(search.keys(search.rows_of(T.token_index(spark, d), "Patient", "segment"), search.token_is(v, m))))


@query("SELECT 'doc-' || doc_id AS resource_id FROM documents WHERE doc_id % 7 = 0")
def search_token_system_only(spark, d):
    return _ids(search.keys(T.metadata_index(spark, d), search.token_is(["urn:label|"])))


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_acctbal >= 0")
def search_token_no_system(spark, d):
    return _ids(search.keys(search.rows_of(T.token_index(spark, d), "Patient", "active"), search.token_is(["|TRUE"])))


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE lower(c_mktsegment) <> 'building'")
def search_token_not(spark, d):
    ix = search.rows_of(T.token_index(spark, d), "Patient", "segment")
    return _ids(search.without(ix.select(*T.KEY).distinct(), search.hits(ix, search.token_is(["building"]))))


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def search_missing(spark, d):
    everyone = T.string_index(spark, d).where("resource_type = 'Patient'").select(*T.KEY).distinct()
    open_ones = search.hits(search.rows_of(T.token_index(spark, d), "Encounter", "status"), search.token_is(["p"]))
    seen = search.only(search.rows_of(T.reference_index(spark, d), "Encounter", "subject"), open_ones).select(F.lit("Patient").alias("resource_type"), F.col("target_id").alias("resource_id")).distinct()
    return _ids(search.without(everyone, seen))


for _p, _sql in {
    "eq": "v >= 19.5 AND v < 20.5", "ne": "v < 19.5 OR v >= 20.5", "gt": "v >= 20.5", "lt": "v < 19.5", "ge": "v >= 19.5", "le": "v < 20.5", "sa": "v >= 20.5", "eb": "v < 19.5", "ap": "abs(v - 20) <= 2"}.items():
    query(f"SELECT 'p-' || p_partkey AS resource_id FROM (SELECT p_partkey, p_size::DOUBLE AS v FROM part) WHERE {_sql}", f"search_number_{_p}")(
        lambda spark, d, p=_p: _ids(search.keys(search.rows_of(T.number_index(spark, d), "Medication", "size"), search.number_is(p, "20"))))


@query("SELECT 'e-' || event_id AS resource_id FROM events WHERE event_type = 'purchase' AND value >= 11.5 AND value < 12.5")
def search_quantity_unit(spark, d):
    return _ids(search.keys(T.quantity_index(spark, d), search.quantity_is("eq", "12|http://unitsofmeasure.org|mg")))


@query("SELECT 'e-' || event_id AS resource_id FROM events WHERE event_type <> 'purchase' AND value >= 50.5")
def search_quantity_unit_only(spark, d):
    return _ids(search.keys(T.quantity_index(spark, d), search.quantity_is("gt", "50||g")))


_RANGE = "SELECT 'o-' || o_orderkey AS resource_id FROM (SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS s, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY AS e, TIMESTAMP '1998-03-01' AS l, TIMESTAMP '1998-04-01' AS h FROM orders) WHERE "
for _p, _sql in {
    "eq": "s >= l AND e <= h", "ne": "e <= l OR s >= h", "gt": "e > h", "lt": "s < l", "ge": "e > l", "le": "s < h", "sa": "s >= h", "eb": "e <= l", "po": "s < h AND e > l",
    "ap": "s < h + INTERVAL 267840 SECOND AND e > l - INTERVAL 267840 SECOND"}.items():
    query(_RANGE + _sql, f"search_date_{_p}")(lambda spark, d, p=_p: _ids(search.keys(search.rows_of(T.date_index(spark, d), "Encounter", "date"), search.date_is(p, "1998-03"))))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE o_custkey IN (3, 7)")
def search_reference(spark, d):
    return _ids(search.keys(search.rows_of(T.reference_index(spark, d), "Encounter", "subject"), search.reference_is(["Patient/c-3", "c-7"])))


@query("SELECT url FROM pages WHERE starts_with(url || '/', (SELECT regexp_extract(min(url), '^https?://[^/]+') FROM pages) || '/')")
def search_uri_below(spark, d):
    """Pages of the site that comes first."""
    pages = T.table(spark, d, "pages")
    site = pages.agg(F.regexp_extract(F.min("url"), "^https?://[^/]+", 0)).first()[0]
    return pages.where(search.uri_is([site + "/"], "below", "url")).select("url")


@query("SELECT 'doc-' || doc_id AS resource_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents) WHERE contains(t, ' the ') AND contains(t, ' of ') AND NOT contains(t, ' stupid ') AND contains(t, ' in the ')")
def text_search(spark, d):
    rows = search.rows_of(T.text_index(spark, d), "DocumentReference", "_content")
    return _ids(search.keys(rows, search.words_match(all_of=["the", "of"], none_of=["stupid"], phrase="in the")))


@query("SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS n FROM pages")
def narrative_strip(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.length(T.narrative(F.col("html"))).cast("long").alias("n"))


@query("SELECT 'e-' || event_id AS resource_id FROM events WHERE event_type = 'purchase' AND value >= 80.5")
def search_composite(spark, d):
    e = T.table(spark, d, "events").select(F.lit("Observation").alias("resource_type"), T.rid("e", "event_id").alias("resource_id"), F.lower("event_type").alias("code_ci"), F.col("event_type").alias("code"), F.lit("urn:event").alias("system"), "value")
    return _ids(search.keys(e, search.composite_is(search.token_is(["purchase"]), search.number_is("gt", "80"))))


# ---- formulas and joins -------------------------------------------------------------------------


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal >= 5000.5 OR c_name LIKE '%77') OR NOT (c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')) AND c_acctbal < -0.5")
def filter_and_or_not(spark, d):
    tokens, numbers = search.rows_of(T.token_index(spark, d), "Patient", "segment"), search.rows_of(T.number_index(spark, d), "Patient", "balance")
    base = tokens.select(*T.KEY).distinct()
    named = {
        "building": search.keys(tokens, search.token_is(["building"])), "rich": search.keys(numbers, search.number_is("gt", "5000")), "debt": search.keys(numbers, search.number_is("lt", "0")),
        "known": search.keys(tokens, search.token_is(["building", "machinery", "furniture"])), "name77": search.keys(search.rows_of(T.string_index(spark, d), "Patient", "name"), F.col("value").endswith("77"))}
    return _ids(search.matching(base, named, "building AND (rich OR name77) OR NOT known AND debt"))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) LIKE 'customer00000002%'")
def chain_patient_name(spark, d):
    found = search.hits(search.rows_of(T.string_index(spark, d), "Patient", "name"), search.string_is(["Customer#00000002"]))
    return _ids(search.chained(T.reference_index(spark, d), "Encounter", "subject", "Patient", found))


@query("SELECT DISTINCT 'c-' || o_custkey AS resource_id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def has_reverse_chain(spark, d):
    tokens = T.token_index(spark, d)
    found = search.only(search.hits(search.rows_of(tokens, "Encounter", "status"), search.token_is(["p"])), search.hits(search.rows_of(tokens, "Encounter", "priority"), search.token_is(["1-urgent"])))
    return _ids(search.referred_by(T.reference_index(spark, d), "Encounter", "subject", "Patient", found))


def _urgent(spark, d):
    return search.keys(search.rows_of(T.token_index(spark, d), "Encounter", "priority"), search.token_is(["1-urgent"]))


@query("SELECT DISTINCT 'c-' || o_custkey AS resource_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def include_forward(spark, d):
    return _ids(search.include(T.reference_index(spark, d), _urgent(spark, d), "Encounter", "subject"))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, 'c-' || c_custkey LIMIT 50)")
def revinclude(spark, d):
    """For a page of fifty."""
    base = search.rows_of(T.string_index(spark, d), "Patient", "name").select(*T.KEY)
    page = search.sorted_page(base, search.sort_key(T.number_index(spark, d), "Patient", "balance", "value"), True, 50)
    return _ids(search.revinclude(T.reference_index(spark, d), page, "Encounter", "subject"))


@query("""WITH p AS (SELECT DISTINCT c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
SELECT 'c-' || c_custkey AS resource_id FROM p UNION SELECT 'n-' || c_nationkey FROM p UNION SELECT 'r-' || n_regionkey FROM p JOIN nation ON c_nationkey = n_nationkey""")
def include_iterate(spark, d):
    steps = [("Encounter", "subject"), ("Patient", "address"), ("Location", "partof")]
    return _ids(search.include_iterate(T.reference_index(spark, d), _urgent(spark, d), steps))


@query("SELECT 'c-5' AS resource_id UNION ALL SELECT 'o-' || o_orderkey FROM orders WHERE o_custkey = 5 UNION ALL SELECT 'e-' || event_id FROM events WHERE user_id = 5")
def compartment_patient(spark, d):
    return _ids(search.compartment(T.reference_index(spark, d), "Patient", "c-5", [("Encounter", "subject"), ("Observation", "subject")]))


@query("SELECT resource_type, count(*) AS n FROM (SELECT 'Patient' AS resource_type UNION ALL SELECT 'Encounter' FROM orders WHERE o_custkey = 5 UNION ALL SELECT 'Observation' FROM events WHERE user_id = 5) GROUP BY 1")
def everything_patient(spark, d):
    rows = search.compartment(T.reference_index(spark, d), "Patient", "c-5", [("Encounter", "subject"), ("Observation", "subject")])
    return rows.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'doc-' || doc_id AS resource_id FROM labels WHERE toxic = 0 AND doc_id % 3 <> 0 AND quality = 1")
def membership_in(spark, d):
    members = T.table(spark, d, "labels").select(
        F.lit("Group").alias("collection_type"), F.concat(F.lit("g-"), F.col("quality").cast("string")).alias("collection_id"), F.lit("DocumentReference").alias("member_type"), T.rid("doc", "doc_id").alias("member_id"),
        (F.col("toxic") == 1).alias("member_inactive"), F.lit(None).cast("timestamp_ntz").alias("period_start"), F.when(F.col("doc_id") % 3 == 0, F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))).alias("period_end"))
    return _ids(search.member_of(members, "Group", "g-1", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))


@query("SELECT count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def reference_integrity(spark, d):
    have = T.table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.lit("Patient").alias("resource_type"), T.rid("c", "c_custkey").alias("resource_id"))
    return search.dangling(search.rows_of(T.reference_index(spark, d), "Observation", "subject"), have).agg(F.count(F.lit(1)).alias("n"))


# ---- order, pages, totals, history --------------------------------------------------------------


@query("SELECT 'c-' || c_custkey AS resource_id, row_number() OVER (ORDER BY m ASC NULLS LAST, 'c-' || c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, min(date_trunc('day', o_orderdate)) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey QUALIFY place <= 50")
def sort_nulls_last(spark, d):
    from pyspark.sql import Window

    o = T.table(spark, d, "orders").where("o_orderstatus = 'P'")
    key = o.groupBy("o_custkey").agg(F.min(F.date_trunc("day", "o_orderdate")).alias("sort_key")).select(F.lit("Patient").alias("resource_type"), T.rid("c", "o_custkey").alias("resource_id"), "sort_key")
    base = T.table(spark, d, "customer").select(F.lit("Patient").alias("resource_type"), T.rid("c", "c_custkey").alias("resource_id"))
    page = search.sorted_page(base, key, False, 50)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.col("sort_key").asc_nulls_last(), "resource_id")).cast("long")).select("resource_id", "place")


@query("SELECT 'o-' || o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' OR (o_orderdate = TIMESTAMP '1999-01-01' AND 'o-' || o_orderkey < 'o-5') ORDER BY o_orderdate DESC, id DESC LIMIT 20")
def page_keyset(spark, d):
    rows = T.table(spark, d, "orders").select(T.rid("o", "o_orderkey").alias("id"), F.col("o_orderdate").alias("last_updated"))
    return search.keyset_page(rows, (F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")), F.lit("o-5")), 20).select("id")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_total(spark, d):
    return search.keys(search.rows_of(T.token_index(spark, d), "Encounter", "status"), search.token_is(["f"])).agg(F.count(F.lit(1)).alias("n"))


_VERSIONS = """WITH v AS (SELECT 'o-' || o_orderkey AS id, o_orderkey, i AS version_id, o_orderdate + (i - 1) * INTERVAL 1 DAY AS last_updated, CASE WHEN i = o_orderkey % 3 + 1 THEN o_orderstatus ELSE 'O' END AS status,
  i = o_orderkey % 3 + 1 AND o_orderkey % 17 = 0 AS deleted, i = o_orderkey % 3 + 1 AS is_current FROM orders, range(1, 4) t(i) WHERE i <= o_orderkey % 3 + 1) """


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_id DESC) AS r FROM v WHERE last_updated <= TIMESTAMP '1997-06-15') WHERE r = 1 AND NOT deleted")
def history_at(spark, d):
    return history.as_of(T.encounters(spark, d), F.to_timestamp_ntz(F.lit("1997-06-15 00:00:00"))).select("id", "version_id", "status")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id, CASE WHEN deleted THEN 'DELETE' WHEN version_id = 1 THEN 'POST' ELSE 'PUT' END AS method FROM v WHERE last_updated >= TIMESTAMP '2001-01-01' ORDER BY last_updated DESC, id DESC, version_id DESC LIMIT 100")
def history_type(spark, d):
    return history.history(T.encounters(spark, d), F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")), resource_type="Encounter").select("id", "version_id", "method")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id, status FROM v WHERE is_current AND NOT deleted")
def current_versions(spark, d):
    return history.current(T.encounters(spark, d)).select("id", "version_id", "status")


@query(_VERSIONS + "SELECT id, version_id::INT AS version_id, is_current AND o_orderkey % 5 <> 0 AS is_current FROM v UNION ALL SELECT 'o-' || o_orderkey, (o_orderkey % 3 + 2)::INT, true FROM orders WHERE o_orderkey % 5 = 0")
def append_update(spark, d):
    v = T.encounters(spark, d)
    changes = T.table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.lit("Encounter").alias("resource_type"), T.rid("o", "o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("last_updated"), F.lit("X").alias("status"), F.lit(False).alias("deleted"), F.col("o_totalprice").alias("total"))
    return history.append_versions(v, changes).select("id", "version_id", "is_current")


@query(_VERSIONS + "SELECT 'Encounter' AS resource_type, count(*) AS versions, count(*) FILTER (WHERE is_current AND NOT deleted) AS active, count(*) FILTER (WHERE is_current AND deleted) AS deleted, strftime(max(last_updated), '%Y-%m-%d') AS last_updated FROM v")
def type_stats(spark, d):
    return reports.type_stats(T.encounters(spark, d)).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("SELECT 'Patient' AS resource_type, 'address' AS parameter_name, count(DISTINCT c_custkey) AS indexed, count(*) AS total, 100.0::DOUBLE AS percent FROM customer UNION ALL SELECT 'Location', 'partof', 25, 30, 83.33")
def coverage_report(spark, d):
    refs = T.reference_index(spark, d).where("(resource_type = 'Patient' AND parameter_name = 'address') OR (resource_type = 'Location' AND parameter_name = 'partof')")
    totals = T.string_index(spark, d).where("resource_type IN ('Patient', 'Location') AND parameter_name = 'name'").groupBy("resource_type").agg(F.count(F.lit(1)).alias("total"))
    return reports.coverage(refs, totals)


@query("SELECT count(p_name) AS n, count(DISTINCT p_name) AS distinct_values, count(DISTINCT p_name) AS distinct_hashes FROM part")
def collision_report(spark, d):
    return reports.collisions(T.table(spark, d, "part"), "p_name")


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE o_orderkey % 7 = 0")
def index_loss(spark, d):
    o = T.table(spark, d, "orders").select(F.lit("Encounter").alias("resource_type"), T.rid("o", "o_orderkey").alias("resource_id"), "o_orderkey")
    return _ids(reports.missing_from_index(o, o.where("o_orderkey % 7 <> 0")))


@query("SELECT 'Encounter' AS resource_type, 'priority,status' AS parameters UNION ALL SELECT 'Medication', 'brand,type' UNION ALL SELECT 'Observation', 'code' UNION ALL SELECT 'Patient', 'active,segment'")
def parameter_catalogue(spark, d):
    return reports.catalogue(T.token_index(spark, d))


# ---- hierarchies and terminology ----------------------------------------------------------------


def _places(spark, d) -> DataFrame:
    n, r = T.table(spark, d, "nation"), T.table(spark, d, "region")
    return n.select(T.rid("n", "n_nationkey").alias("child"), T.rid("r", "n_regionkey").alias("parent")).unionByName(r.select(T.rid("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@query("SELECT 'world' AS node UNION ALL SELECT 'r-' || r_regionkey FROM region UNION ALL SELECT 'n-' || n_nationkey FROM nation")
def hierarchy_below(spark, d):
    return hierarchy.below(hierarchy.closure(_places(spark, d)), "world")


@query("SELECT 'n-3' AS node UNION ALL SELECT 'r-' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'world'")
def hierarchy_above(spark, d):
    return hierarchy.above(hierarchy.closure(_places(spark, d)), "n-3")


@query("SELECT 'r-2' AS node UNION ALL SELECT 'world' UNION ALL SELECT 'n-' || n_nationkey FROM nation WHERE n_regionkey = 2")
def hierarchy_contains(spark, d):
    return hierarchy.around(hierarchy.closure(_places(spark, d)), "r-2")


def _concepts(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    leaf = p.select("p_brand", "p_type").distinct().select(F.lit("urn:product").alias("system"), F.concat_ws("/", "p_brand", "p_type").alias("code"), F.lower("p_type").alias("display"), F.col("p_brand").alias("parent"), (F.col("p_type") != "PROMO").alias("active"))
    brand = p.select("p_brand").distinct().select(F.lit("urn:product").alias("system"), F.col("p_brand").alias("code"), F.lower("p_brand").alias("display"), F.lit("product").alias("parent"), F.lit(True).alias("active"))
    return leaf.unionByName(brand)


def _tree(spark, d) -> DataFrame:
    return hierarchy.closure(_concepts(spark, d), "code", "parent")


@query("""SELECT code FROM (SELECT DISTINCT p_brand || '/' || p_type AS code, p_type FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') UNION SELECT DISTINCT p_brand, '' FROM part WHERE p_brand = 'Brand#2')
WHERE p_type NOT IN ('PROMO', 'SMALL')""")
def valueset_expand(spark, d):
    c = _concepts(spark, d)
    include = [{"system": "urn:product", "is_a": "Brand#2"}, {"system": "urn:product", "descendent_of": "Brand#4"}]
    return terminology.expand(c, _tree(spark, d), include, [{"system": "urn:product", "where": "display = 'small'"}], active_only=True).select("code")


@query("SELECT DISTINCT p_brand || '/' || p_type AS code, 'parent' AS property, p_brand AS value FROM part WHERE p_brand = 'Brand#2' AND p_type = 'SMALL'")
def lookup_code(spark, d):
    c = _concepts(spark, d)
    properties = c.select("system", "code", F.lit("parent").alias("property"), F.col("parent").alias("value"))
    return terminology.lookup(c, properties, "urn:product", "Brand#2/SMALL").select("code", "property", "value")


@query("SELECT l_returnflag AS code, l_returnflag IN ('A', 'R') AS valid, count(*) AS n FROM lineitem GROUP BY 1, 2")
def validate_codes(spark, d):
    codes = T.table(spark, d, "lineitem").select(F.lit("urn:flag").alias("system"), F.col("l_returnflag").alias("code"))
    good = spark.createDataFrame([("urn:flag", "A"), ("urn:flag", "R")], "system string, code string")
    return terminology.validate(codes, good).groupBy("code", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN a = b THEN 'equivalent' WHEN starts_with(b, a || '/') THEN 'subsumes' WHEN starts_with(a, b || '/') THEN 'subsumed-by' ELSE 'not-subsumed' END AS outcome FROM
(SELECT p_brand || '/' || p_type AS a, p_brand AS b FROM part UNION ALL SELECT p_brand, p_brand || '/' || p_type FROM part UNION ALL SELECT p_brand, p_brand FROM part UNION ALL SELECT p_brand || '/' || p_type, 'Brand#2' FROM part)) GROUP BY 1""")
def subsumes_pairs(spark, d):
    p = T.table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("leaf"), "p_brand")
    b = F.col("p_brand")
    pairs = p.select(F.col("leaf").alias("a"), b.alias("b")).unionByName(p.select(b.alias("a"), F.col("leaf").alias("b"))).unionByName(p.select(b.alias("a"), b.alias("b"))).unionByName(p.select(F.col("leaf").alias("a"), F.lit("Brand#2").alias("b")))
    return terminology.subsumes(pairs, _tree(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS code, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'planned' END AS to_code, o_orderstatus = 'F' AS matched, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def translate_codes(spark, d):
    mapping = spark.createDataFrame([("urn:status", "F", "urn:encounter", "finished", "equal"), ("urn:status", "O", "urn:encounter", "planned", "unmatched")], "source_system string, source_code string, target_system string, target_code string, equivalence string")
    codes = T.table(spark, d, "orders").select(F.lit("urn:status").alias("system"), F.col("o_orderstatus").alias("code"))
    return terminology.translate(codes, mapping).groupBy("code", "to_code", "matched").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS code, count(*) AS n, round(sum(value * CASE WHEN event_type = 'purchase' THEN 0.001 ELSE 1 END * 1000), 3) AS total FROM events GROUP BY 1")
def units_convert(spark, d):
    e = T.table(spark, d, "events").select("event_type", "value", F.when(F.col("event_type") == "purchase", "mg").otherwise("g").alias("unit"))
    return units.converted(e, "mg").groupBy(F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("converted"), 3).alias("total"))


@query("SELECT 'e-' || event_id AS resource_id FROM events WHERE event_type <> 'purchase' AND value >= 40 OR event_type = 'purchase' AND value * 0.001 >= 40")
def units_compare(spark, d):
    return _ids(units.comparable_with(T.quantity_index(spark, d), 0.04, "kg"))


# ---- validation ---------------------------------------------------------------------------------


@query("""SELECT rule, severity, count(*) AS n, count(DISTINCT id) AS documents FROM (
SELECT o_orderkey AS id, 'status-pattern' AS rule, 'error' AS severity FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[FO]$')
UNION ALL SELECT o_orderkey, 'total-positive', 'error' FROM orders WHERE NOT o_totalprice > 1000
UNION ALL SELECT o_orderkey, 'urgent-open', 'warning' FROM orders WHERE NOT (o_orderpriority <> '1-URGENT' OR o_orderstatus = 'O')) GROUP BY 1, 2""")
def invariant_check(spark, d):
    checks = [rules.required("o_custkey"), rules.pattern("o_orderstatus", "^[FO]$"), rules.invariant("total-positive", "o_totalprice > 1000"), rules.invariant("urgent-open", "o_orderpriority <> '1-URGENT' OR o_orderstatus = 'O'", "warning")]
    return rules.summary(rules.issues(T.table(spark, d, "orders"), "o_orderkey", checks)).withColumn("rule", F.when(F.col("rule") == "o_orderstatus-pattern", "status-pattern").otherwise(F.col("rule")))


@query("SELECT p_partkey AS id, 'p_type-binding' AS rule, 'error' AS severity FROM part WHERE p_type NOT IN ('PROMO', 'SMALL', 'LARGE')")
def binding_check(spark, d):
    allowed = spark.createDataFrame([("PROMO",), ("SMALL",), ("LARGE",)], "code string")
    return rules.binding(T.table(spark, d, "part"), "p_partkey", "p_type", allowed).select("id", "rule", "severity")


# ---- path functions -----------------------------------------------------------------------------

_LINES = "SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS q, list(l_extendedprice ORDER BY l_extendedprice) AS x FROM lineitem GROUP BY l_orderkey"


def _lines(spark, d) -> DataFrame:
    return T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"), F.array_sort(F.collect_list("l_extendedprice")).alias("x"))


@query(f"SELECT l_orderkey, len(list_filter(q, lambda v: v > 25)) AS n, round(list_sum(list_transform(list_filter(q, lambda v: v > 25), lambda v: v * 2)), 6) AS total FROM ({_LINES}) WHERE len(list_filter(q, lambda v: v > 25)) > 0")
def fp_where_select(spark, d):
    big = C.where(F.col("q"), lambda v: v > 25)
    total = C.aggregate(C.select(big, lambda v: F.array(v * 2)), F.lit(0.0), lambda a, v: a + v)
    return _lines(spark, d).where(~C.empty(big)).select("l_orderkey", C.count(big).cast("long").alias("n"), F.round(total, 6).alias("total"))


@query(f"SELECT l_orderkey, round(list_sum(x), 4) AS total FROM ({_LINES})")
def fp_aggregate_sum(spark, d):
    return _lines(spark, d).select("l_orderkey", F.round(C.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"SELECT l_orderkey, list_max(q) > 45 AS any_big, list_min(q) > 5 AS all_some, len(q) = len(list_distinct(q)) AS own FROM ({_LINES})")
def fp_exists_all(spark, d):
    q = F.col("q")
    return _lines(spark, d).select("l_orderkey", C.exists(q, lambda v: v > 45).alias("any_big"), C.all_(q, lambda v: v > 5).alias("all_some"), C.is_distinct(q).alias("own"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS u, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), ' ') AS i, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS e, len(a) + len(b) AS n
FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ring red', ' ') AS b FROM part)""")
def fp_distinct_union(spark, d):
    a, b = F.split("p_name", " "), F.split(F.concat(F.lower("p_type"), F.lit(" ring red")), " ")
    return T.table(spark, d, "part").select("p_partkey", F.array_join(C.sort(C.union(a, b)), " ").alias("u"), F.array_join(C.sort(C.intersect(a, b)), " ").alias("i"), F.array_join(C.exclude(a, b), " ").alias("e"), C.count(C.combine(a, b)).cast("long").alias("n"))


@query(f"SELECT l_orderkey, q[1] AS head, q[len(q)] AS final, len(q[2:]) AS rest, len(q[3:]) AS skipped, len(q[1:2]) AS taken, CASE WHEN len(q) > 1 THEN q[2] END AS second FROM ({_LINES})")
def fp_subsetting(spark, d):
    q = F.col("q")
    return _lines(spark, d).select("l_orderkey", C.one(C.first(q)).alias("head"), C.one(C.last(q)).alias("final"), F.size(C.tail(q)).cast("long").alias("rest"), F.size(C.skip(q, 2)).cast("long").alias("skipped"), F.size(C.take(q, 2)).cast("long").alias("taken"), C.one(C.at(q, 1)).alias("second"))


@query("""SELECT p_partkey, upper(p_name) AS up, strpos(p_name, 'ing') - 1 AS at, CASE WHEN length(p_name) > 2 THEN substring(p_name, 3, 4) END AS part, starts_with(p_name, 'small') AS starts, ends_with(p_name, 'ring') AS ends,
replace(p_name, ' ', '_') AS swapped, regexp_matches(p_name, 'r.n') AS hit, regexp_full_match(p_name, '[a-z ]+') AS whole, octet_length(encode(p_name)) AS n, lower(hex(encode(p_name))) AS hexed, base64(encode(p_name)) AS b64 FROM part""")
def fp_strings(spark, d):
    x = F.col("p_name")
    return T.table(spark, d, "part").select(
        "p_partkey", F.upper(x).alias("up"), S.index_of(x, "ing").cast("long").alias("at"), S.substring(x, 2, 4).alias("part"), x.startswith("small").alias("starts"), x.endswith("ring").alias("ends"), F.replace(x, F.lit(" "), F.lit("_")).alias("swapped"),
        S.matches(x, "r.n").alias("hit"), S.matches_full(x, "[a-z ]+").alias("whole"), S.length(x).cast("long").alias("n"), S.encode(x, "hex").alias("hexed"), S.encode(x, "base64").alias("b64"))


@query("""SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l,
round(pow(c_acctbal, 2), 2) AS p, trunc(c_custkey / 7)::BIGINT AS d, c_custkey % 7 AS m FROM customer""")
def fp_math(spark, d):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    return T.table(spark, d, "customer").select(
        "c_custkey", F.abs(x).alias("a"), F.ceil(x).cast("double").alias("c"), F.floor(x).cast("double").alias("f"), S.truncate(x).cast("double").alias("t"), F.round(S.sqrt(x), 6).alias("s"), F.round(S.ln(x), 6).alias("l"), F.round(S.power(x, 2), 2).alias("p"),
        S.div(k, F.lit(7)).alias("d"), S.mod(k, F.lit(7)).alias("m"))


@query("""SELECT event_id, CASE WHEN k % 2 = 0 THEN true ELSE NULL END AS b, k AS i, k::VARCHAR AS s, strftime(ts, '%Y-%m') AS m, 6 AS p FROM (SELECT event_id, ts, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def fp_convert(spark, d):
    k = F.get_json_object("props", "$.k")
    even = F.when(S.to_integer(k) % 2 == 0, F.lit("yes")).otherwise("maybe")
    month = F.date_format("ts", "yyyy-MM")
    return T.table(spark, d, "events").select("event_id", S.to_boolean(even).alias("b"), S.to_integer(k).alias("i"), k.alias("s"), month.alias("m"), S.date_precision(month).alias("p"))


@query("SELECT 'c-' || c_custkey AS id, c_name AS family, lower(c_mktsegment) AS given, lpad(c_custkey::VARCHAR, 8, '0') AS mrn FROM customer WHERE c_acctbal >= 0")
def document_paths(spark, d):
    docs = T.patient_documents(spark, d).withColumn("v", F.parse_json("resource"))

    def at(path: str):
        return F.try_variant_get("v", path, "string")

    return docs.where(F.try_variant_get("v", "$.active", "boolean")).select("id", at("$.name[0].family").alias("family"), at("$.name[0].given[0]").alias("given"), at("$.identifier[0].value").alias("mrn"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def bundle_of_entries(spark, d):
    c = T.table(spark, d, "conversations")
    return reports.bundle_detail(c.select("conv_id").distinct(), c, "conv_id", "turn", "role").select("conv_id", F.col("entries").alias("turns"), F.array_join("role", ">").alias("roles"))
