"""More queries: extraction from nested documents, result shapes, conditional writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import temporal
from lattica.operators import extract, hierarchy, history, reports, search, shape
from lattica.plans.queries import query
from lattica.sources import tables as T

_PATIENT = "resourceType string, id string, name array<struct<family:string, given:array<string>>>, identifier array<struct<system:string, value:string>>, active boolean"


def _patients(spark, d):
    return T.patient_documents(spark, d).select(F.from_json("resource", _PATIENT).alias("p")).select("p.*")


@query("SELECT DISTINCT 'c-' || c_custkey AS resource_id, value, lower(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) AS value_normalized FROM (SELECT c_custkey, c_name AS value FROM customer UNION ALL SELECT c_custkey, lower(c_mktsegment) FROM customer)")
def extract_name_strings(spark, d):
    return extract.index_rows(_patients(spark, d), F.col("id"), "Patient", "name", extract.name_strings(F.col("name"))).select("resource_id", "value", "value_normalized")


@query("SELECT 'c-' || c_custkey AS resource_id, 'urn:mrn' AS system, lpad(c_custkey::VARCHAR, 8, '0') AS code FROM customer")
def extract_identifier_tokens(spark, d):
    return extract.index_rows(_patients(spark, d), F.col("id"), "Patient", "identifier", extract.identifier_tokens(F.col("identifier"))).select("resource_id", "system", "code")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'relative' WHEN 1 THEN 'absolute' WHEN 2 THEN 'canonical' ELSE 'fragment' END AS kind, CASE WHEN o_orderkey % 4 < 2 THEN 'Patient' END AS target_type,
CASE WHEN o_orderkey % 4 < 2 THEN 'c-' || o_custkey END AS target_id, CASE o_orderkey % 4 WHEN 0 THEN '2' WHEN 2 THEN '1.0' END AS version FROM orders""")
def parse_references(spark, d):
    key = T.rid("c", "o_custkey")
    literal = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Patient/"), key, F.lit("/_history/2"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("https://h.org/r4/Patient/"), key)).when(F.col("o_orderkey") % 4 == 2, F.lit("http://h.org/Questionnaire/q|1.0")).otherwise(F.lit("#contained"))
    r = extract.parsed_reference(literal)
    return T.table(spark, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.kind", "r.target_type", "r.target_id", "r.version")


@query("""SELECT o_orderkey, strftime(date_trunc(u, o_orderdate), '%Y-%m-%d') AS low, strftime(date_trunc(u, o_orderdate) + CASE u WHEN 'year' THEN INTERVAL 1 YEAR WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END, '%Y-%m-%d') AS high
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS u FROM orders)""")
def extract_date_ranges(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    r = T.table(spark, d, "orders").select("o_orderkey", extract.date_range(text).alias("r"))
    return r.select("o_orderkey", F.date_format("r.start_date", "yyyy-MM-dd").alias("low"), F.date_format("r.end_date", "yyyy-MM-dd").alias("high"))


@query("SELECT l_orderkey, sum(a) AS pairs FROM (SELECT l_orderkey, count(*) AS a FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) r JOIN (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem) s USING (l_orderkey) GROUP BY 1) GROUP BY 1")
def composite_tuples(spark, d):
    g = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return g.select("l_orderkey", F.size(extract.composite_tuples(F.col("a"), F.col("b"))).cast("long").alias("pairs"))


@query("SELECT DISTINCT 'g-' || quality AS collection_id, 'doc-' || doc_id AS member_id FROM labels WHERE quality = 1")
def membership_edges(spark, d):
    # a row for each member, as an array of one: no array grows with its collection
    g = T.table(spark, d, "labels").select("quality", F.array(F.concat(F.lit("DocumentReference/doc-"), F.col("doc_id").cast("string"))).alias("member"), T.rid("g", "quality").alias("id"))
    return extract.membership_edges(g, "Group", "id", "member", F.col("quality") == 1).select("collection_id", "member_id")


@query("SELECT 'c-' || c_custkey AS id, 'SUBSETTED' AS tag, c_acctbal >= 0 AS active, 'Patient' AS \"resourceType\" FROM customer")
def elements_only(spark, d):
    return shape.elements(_patients(spark, d), ["active"])


@query("SELECT count(*) AS total FROM customer")
def summary_count(spark, d):
    return shape.summary(_patients(spark, d), "count")


@query("SELECT 'match' AS mode, '{\"resource\":\"o-' || o_orderkey || '\",\"search\":{\"mode\":\"match\"}}' AS entry FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT 'include', '{\"resource\":\"c-' || o_custkey || '\",\"search\":{\"mode\":\"include\"}}' FROM orders WHERE o_orderpriority = '1-URGENT'")
def searchset_entries(spark, d):
    page = search.keys(search.rows_of(T.token_index(spark, d), "Encounter", "priority"), search.token_is(["1-urgent"]))
    return shape.searchset(page, search.include(T.reference_index(spark, d), page, "Encounter", "subject"), F.col("resource_id"))


@query("""SELECT p_partkey AS request_id, CASE n WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'conflict' END AS action, CASE WHEN n = 1 THEN t END AS target
FROM (SELECT p_partkey, count(c_custkey) AS n, min('c-' || c_custkey) AS t FROM part LEFT JOIN customer ON p_size = 1 + c_custkey // 4 % 60 AND c_custkey % 4 < p_size % 4 GROUP BY 1)""")
def conditional_writes(spark, d):
    c = T.table(spark, d, "customer").withColumn("p_size", 1 + F.floor(F.col("c_custkey") / 4) % 60)
    found = c.where("c_custkey % 4 < p_size % 4").select("p_size", T.rid("c", "c_custkey").alias("resource_id"))
    return shape.conditional_on(T.table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), "p_size"), found, "p_size").select("request_id", "action", "target")


@query("""SELECT p_partkey AS request_id, CASE coalesce(n, 0) WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'conflict' END AS action, CASE WHEN n = 1 THEN t END AS target
FROM part LEFT JOIN (SELECT o_custkey, count(*) AS n, min('o-' || o_orderkey) AS t FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON p_partkey = o_custkey""")
def conditional_writes_by_key(spark, d):
    """Writes of an urgent Encounter of subject c-N, matched against all of them."""
    documents = T.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("request_id"), T.rid("o", "o_orderkey").alias("resource_id"))
    return shape.conditional_on(T.table(spark, d, "part").select(F.col("p_partkey").alias("request_id")), documents, "request_id").select("request_id", "action", "target")


@query("SELECT p_partkey FROM part WHERE p_size = 1 OR p_size BETWEEN 10 AND 19")
def canonical_version_prefix(spark, d):
    docs = T.table(spark, d, "part").select("p_partkey", F.lit("http://h.org/p").alias("url"), F.regexp_replace(F.col("p_size").cast("string"), "^1(?=.)", "1.").alias("version"))
    return shape.by_canonical(docs, "http://h.org/p", "1").select("p_partkey")


# ---- dates, quantities, documents ---------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_on, strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%d') AS days_back, strftime(last_day(o_orderdate), '%Y-%m-%d') AS high FROM orders")
def fp_durations(spark, d):
    o = F.col("o_orderdate")
    return T.table(spark, d, "orders").select(
        "o_orderkey", F.date_format(temporal.add_duration(o, 1, "month"), "yyyy-MM-dd").alias("month_on"), F.date_format(temporal.add_duration(o, -10, "days"), "yyyy-MM-dd").alias("days_back"),
        F.date_format(temporal.high_date(F.date_format(o, "yyyy-MM")), "yyyy-MM-dd").alias("high"))


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-15' AND o_orderdate <= TIMESTAMP '1997-06-15'")
def search_age(spark, d):
    after, until = temporal.born_between(F.lit("2000-06-15").cast("date"), 3)
    day = F.col("start_date").cast("date")
    return search.keys(search.rows_of(T.date_index(spark, d), "Encounter", "date"), (day > after) & (day <= until)).select("resource_id")


@query("SELECT event_id, round(CASE WHEN event_type = 'purchase' THEN value + 2 ELSE value * 1000 + 2 END, 6) AS total, 'mg' AS unit FROM events")
def fp_quantity_add(spark, d):
    e = T.table(spark, d, "events")
    q = temporal.add_quantities(temporal.quantity(F.col("value"), F.when(F.col("event_type") == "purchase", "mg").otherwise("g")), temporal.quantity(F.lit(2), F.lit("mg")), {"g": 1.0, "mg": 0.001})
    return e.select("event_id", q.alias("q")).select("event_id", F.round("q.value", 6).alias("total"), "q.unit")


@query("SELECT 'c-' || c_custkey AS id, k AS child FROM customer, (SELECT unnest(['resourceType', 'id', 'name', 'identifier', 'active']) AS k)")
def fp_children(spark, d):
    docs = T.patient_documents(spark, d).withColumn("v", F.parse_json("resource"))
    return docs.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", F.col("key").alias("child"))


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS waiting, round(avg(value), 6) AS mean FROM events")
def queue_stats(spark, d):
    e = T.table(spark, d, "events")
    known = {r.event_type for r in e.select("event_type").distinct().collect()}
    return reports.queue_stats(e, "event_type", {"failed": ["error"], "done": ["purchase"], "waiting": sorted(known - {"error", "purchase"})}, "value")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_brand = 'Brand#2' ORDER BY p_partkey LIMIT 10 OFFSET 5")
def catalogue_page(spark, d):
    return reports.listing(T.table(spark, d, "part"), ["p_partkey"], {"p_brand": "Brand#2"}, "ring", ["p_name"], 5, 10).select("p_partkey", "p_name")


@query("SELECT DISTINCT 'd' AS kind, l_orderkey FROM lineitem WHERE l_partkey = 7")
def referencing_scan(spark, d):
    rows = T.reference_index(spark, d).where((F.col("target_type") == "Medication") & (F.col("target_id") == "p-7"))
    return rows.select(F.lit("d").alias("kind"), F.split("resource_id", "-")[1].cast("long").alias("l_orderkey")).distinct()


@query("SELECT 'o-' || o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def batch_read(spark, d):
    wanted = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("Encounter").alias("resource_type"), T.rid("o", "l_orderkey").alias("id"))
    rows = T.encounters(spark, d).where("is_current").join(wanted, ["resource_type", "id"], "left_semi")
    return rows.select("id", "status")


@query("SELECT c_nationkey, count(*) AS n, count(o.o_custkey) AS with_orders FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey GROUP BY 1")
def counts_by_group(spark, d):
    return reports.counts_with(T.table(spark, d, "customer"), T.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_nationkey", "with_orders")


@query("SELECT url FROM pages WHERE url = 'https://a.example.org/x/y' OR starts_with('https://a.example.org/x/y', regexp_replace(url, '/+$', '') || '/') OR contains(lower(regexp_replace(url, '/+$', '')), 'utm_source')")
def search_uri_above_contains(spark, d):
    return T.table(spark, d, "pages").where(search.uri_is(["https://a.example.org/x/y"], "above", "url") | search.uri_is(["utm_source"], "contains", "url")).select("url")


@query("SELECT 'c-' || c_custkey AS resource_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def reference_below(spark, d):
    tree = hierarchy.closure(T.reference_index(spark, d).where("resource_type = 'Location'").select(F.col("resource_id").alias("child"), F.col("target_id").alias("parent")))
    places = hierarchy.below(tree, "r-1").select(F.lit("Location").alias("resource_type"), F.col("node").alias("resource_id"))
    return search.chained(T.reference_index(spark, d), "Patient", "address", "Location", places).select("resource_id")


@query("SELECT 'o-' || o_orderkey AS resource_id FROM orders JOIN labels ON o_custkey = doc_id WHERE toxic = 1")
def reference_member(spark, d):
    group = T.table(spark, d, "labels").where("toxic = 1").select(F.lit("Patient").alias("resource_type"), T.rid("c", "doc_id").alias("resource_id")).distinct()
    return search.chained(T.reference_index(spark, d), "Encounter", "subject", "Patient", group).select("resource_id")


@query("SELECT 'Encounter' AS resource_type, 'o-' || o_orderkey AS id, 1 AS least FROM orders WHERE o_orderkey % 17 = 0")
def deleted_documents(spark, d):
    return history.deleted(T.encounters(spark, d)).select("resource_type", "id", F.lit(1).alias("least"))
