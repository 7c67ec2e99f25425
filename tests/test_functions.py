"""Path functions and operators on small fixtures: empty collections, order, precision, cycles, streams."""

import pytest
from pyspark.sql import functions as F

import lattica.plans.extra  # noqa: F401
import lattica.plans.more  # noqa: F401
from lattica.functions import collections as C
from lattica.functions import scalars as S
from lattica.operators import extract, hierarchy, history, rules, search, shape
from lattica.plans.queries import QUERIES
from lattica.sources import tables as T
from lattica.streaming.indexing import index_stream, latest_rows, version_stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")


def test_collections_keep_order_and_repeats(spark):
    got = spark.range(1).select(
        C.union(arr(3, 1, 3), arr(2, 1)).alias("union"), C.union(arr(), arr(2, 2)).alias("one_side"), C.exclude(arr(1, 1, 2), arr(2)).alias("exclude"), C.intersect(arr(3, 1, 1), arr(1, 3)).alias("intersect"),
        C.tail(arr(1, 2, 3)).alias("tail"), C.last(arr()).alias("last"), C.take(arr(1, 2), 5).alias("take"), C.at(arr(1, 2), 7).alias("at"), C.lift(F.lit(None).cast("int")).alias("lift"), C.one(arr(1, 2)).alias("one"),
        C.member_in(arr(1), arr()).alias("in_none"), C.member_in(arr(), arr(1)).alias("none_in"), C.equals(arr(1, 2), arr(2, 1)).alias("equals"), C.equals(arr(), arr(1)).alias("unknown"), C.equivalent(arr(1, 2), arr(2, 1)).alias("equivalent"),
        C.all_(arr(), lambda x: x > 1).alias("vacuous"), C.exists(arr()).alias("none"), C.subset_of(arr(), arr(1)).alias("subset"), C.superset_of(arr(1), arr(1, 2)).alias("superset"),
        C.all_true(arr(True)).alias("at"), C.any_false(arr(True)).alias("af")).first()
    assert list(got) == [[3, 1, 2], [2, 2], [1, 1], [3, 1], [2, 3], [], [1, 2], [], [], None, False, None, False, None, True, True, False, True, False, True, False]


def test_logic_is_three_valued(spark):
    null, true, false = (F.lit(x).cast("boolean") for x in (None, True, False))
    assert [value(spark, x) for x in (C.and_(null, false), C.or_(null, true), C.xor(true, null), C.implies(null, true), C.implies(false, null))] == [False, True, None, True, True]


def test_strings(spark):
    x = F.lit(" éa b ")
    assert value(spark, S.trim(x)) == "éa b" and value(spark, S.length(F.lit("é"))) == 2
    assert value(spark, S.index_of(F.lit("éab"), "a")) == 2 and value(spark, S.last_index_of(F.lit("aéa"), "a")) == 3 and value(spark, S.index_of(F.lit("a"), "z")) == -1
    assert value(spark, S.substring(F.lit("abc"), 5)) is None and value(spark, S.substring(F.lit("abc"), 1)) == "bc"
    for kind in ("hex", "base64", "urlbase64"):
        assert value(spark, S.decode(S.encode(F.lit("a?>é"), kind), kind)) == "a?>é"
    for kind in ("html", "json"):
        assert value(spark, S.unescape(S.escape(F.lit('<a & "b">\n'), kind), kind)) == '<a & "b">\n'
    assert value(spark, S.to_chars(F.lit("ab"))) == ["a", "b"] and value(spark, S.split(F.lit("a.b"), ".")) == ["a", "b"] and value(spark, S.folded(F.lit("É-a 1"))) == "ea1"
    assert value(spark, S.matches(F.lit("a\nb"), "a.b")) and not value(spark, S.matches_full(F.lit("xab"), "ab"))


def test_numbers_and_conversions(spark):
    assert value(spark, S.div(F.lit(-7), F.lit(2))) == -3 and value(spark, S.div(F.lit(1), F.lit(0))) is None and value(spark, S.mod(F.lit(-7), F.lit(2))) == -1
    assert value(spark, S.round_even(F.lit(2.5))) == 2 and value(spark, S.sqrt(F.lit(-1.0))) is None and value(spark, S.power(F.lit(-8.0), 0.5)) is None
    assert value(spark, S.add(F.lit(2**63 - 1), F.lit(1))) is None and value(spark, S.truncate(F.lit(-1.7))) == -1
    assert value(spark, S.to_boolean(F.lit("yes"))) is True and value(spark, S.converts_to_boolean(F.lit("yes"))) is False
    assert value(spark, S.to_integer(F.lit("+1"))) is None and value(spark, S.to_integer(F.lit("-12"))) == -12 and str(value(spark, S.to_date(F.lit("2020-02")))) == "2020-02-01"
    assert value(spark, S.compare_dates(F.lit("2020"), F.lit("2020-01"))) is None and value(spark, S.to_quantity(F.lit("4.5 'mg'"))).unit == "mg"


@pytest.mark.parametrize(("literal", "half"), [("100", "0.5"), ("1.20", "0.005"), ("5e2", "50")])
def test_precision_of_numbers(literal, half):
    assert float(search.precision_of(literal)) == float(half)


def test_conditional_writes_count_before_they_join(spark):
    requests = spark.createDataFrame([(i, "many") for i in range(300)] + [(900, "one"), (901, "none"), (902, None)], "request_id long, name string")
    documents = spark.createDataFrame([("many", f"d-{i}") for i in range(300)] + [("one", "d-900"), (None, "d-901")], "name string, resource_id string")
    out = shape.conditional_on(requests, documents, "name")
    got = {r.request_id: (r.matches, r.action, r.target) for r in out.collect()}
    assert got == {i: (300, "conflict", None) for i in range(300)} | {900: (1, "update", "d-900"), 901: (0, "create", None), 902: (0, "create", None)}
    for name in ("conditional_writes", "conditional_writes_by_key"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("Aggregate") and plan.count("Aggregate") == 1
    assert QUERIES["conditional_writes_by_key"](spark, "/root/testdata/sf0.01").where("request_id >= 160 AND action <> 'create'").count() > 0


def test_membership_holds_no_collection_in_one_row(spark):
    plan = QUERIES["membership_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", None)], "child string, parent string")
    tree = hierarchy.closure(edges)
    assert {r.node for r in hierarchy.above(tree, "d").collect()} == {"a", "b", "c", "d"} and tree.where("descendant = 'a' AND ancestor = 'a'").count() == 1


def test_closure_of_deep_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 90), (100, 200)], "child int, parent int")
    after = {}
    for a, b in edges.collect():
        after.setdefault(a, []).append(b)
    want = set()
    for start in [*range(101), 200]:
        far, front = {start: 0}, [start]
        for x in front:
            for y in after.get(x, []):
                if y not in far:
                    far[y] = far[x] + 1
                    front.append(y)
        want |= {(start, x, n) for x, n in far.items()}
    got = [(r.descendant, r.ancestor, r.distance) for r in hierarchy.closure(edges).collect()]
    assert len(got) == len(want) and set(got) == want and max(n for _, _, n in got) > 64


def test_versions(spark):
    v = spark.createDataFrame([("P", "1", 1, "2020-01-01", "x", False, False), ("P", "1", 2, "2020-02-01", "y", False, True), ("P", "2", 1, "2020-01-05", "z", False, True)], "resource_type string, id string, version_id int, last_updated string, status string, deleted boolean, is_current boolean")
    gone = spark.createDataFrame([("P", "1", "2020-03-01", None, True)], "resource_type string, id string, last_updated string, status string, deleted boolean")
    after = history.append_versions(v, gone)
    assert {r.id for r in history.current(after).collect()} == {"2"} and history.as_of(after, F.lit("2020-02-15")).where("id = '1'").first().status == "y"
    assert [r.method for r in history.history(after, id="1").collect()] == ["DELETE", "PUT", "POST"]
    assert history.purge(after, after.where("id = '1'").select("resource_type", "id").distinct()).count() == 1
    guard = spark.createDataFrame([("P", "1", 1), ("P", "2", 1)], "resource_type string, id string, expected_version int")
    assert [r.id for r in history.guarded(v, guard).collect()] == ["2"]
    assert history.changed_elements(v, ["status"]).where("status_changed").count() == 1


def test_rules_and_profiles(spark):
    rows = spark.createDataFrame([("1", ["a"], "x"), ("2", [], None), ("3", None, "y")], "id string, names array<string>, code string")
    found = {(r.id, r.rule) for r in rules.issues(rows, "id", [rules.cardinality("names", 1, 2), rules.required("code"), rules.fixed("code", "x")]).collect()}
    assert found == {("2", "names-cardinality"), ("3", "names-cardinality"), ("2", "code-required"), ("3", "code-fixed")}
    schema = "path string, min int, max int, types array<string>, binding string"
    base = spark.createDataFrame([("a", 0, 5, ["s", "t"], None), ("b", 0, 1, ["s"], "v")], schema)
    diff = spark.createDataFrame([("a", 1, 9, ["t", "u"], "w")], schema)
    snap = rules.merged_snapshot(base, diff)
    a = snap.where("path = 'a'").first()
    assert (a.min, a.max, a.types, a.binding) == (1, 5, ["t"], "w") and [r.path for r in rules.differential(base, snap).collect()] == ["a"]


def test_references_and_ranges(spark):
    rows = spark.createDataFrame([("Patient/1",), ("#x",), ("http://h/Patient/1/_history/3",), ("http://h/q|2",), (None,)], "x string")
    got = [tuple(r) for r in rows.select(extract.parsed_reference(F.col("x")).alias("r")).select("r.kind", "r.target_id", "r.version").collect()]
    assert got == [("relative", "1", None), ("fragment", None, None), ("absolute", "1", "3"), ("canonical", None, "2"), (None, None, None)]
    ends = spark.createDataFrame([("2020",), ("2020-02",), ("2020-02-30",), ("x",), ("2020-02-03T04:05",)], "x string").select(extract.date_range(F.col("x")).alias("r")).select(F.col("r.end_date").cast("string").alias("e")).collect()
    assert [r.e for r in ends] == ["2021-01-01 00:00:00", "2020-03-01 00:00:00", None, None, "2020-02-03 04:06:00"]


def test_index_sink_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("P", "1", "name", "a"), ("P", "1", "name", "a"), ("P", "2", "code", "b")], "resource_type string, resource_id string, parameter_name string, value string")
    T.write_index(rows, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    assert back.count() == 2 and search.rows_of(back, "P", "name").count() == 1
    schema = "resource_type string, id string, version_id int, name string, deleted boolean"
    source, out = str(tmp_path / "versions"), str(tmp_path / "out")

    def extracted(df):
        return df.select("resource_type", F.col("id").alias("resource_id"), "version_id", F.lit("name").alias("parameter_name"), F.col("name").alias("value"))

    for batch in ([("P", "1", 1, "a", False), ("P", "1", 2, "b", False), ("P", "2", 1, "c", False)], [("P", "1", 3, "d", False)]):
        df = spark.createDataFrame(batch, schema)
        df.write.mode("append").parquet(source)
        index_stream(version_stream(spark, source, df.schema), extracted, out, str(tmp_path / "progress")).awaitTermination()
    assert {(r.resource_id, r.value) for r in latest_rows(spark, out).collect()} == {("1", "d"), ("2", "c")}


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"resourceType": "Patient",\n "id": "1"}')
    assert '"id": "1"' in T.documents_from_directory(spark, str(tmp_path / "*.json")).first().resource
    (tmp_path / "b.xml").write_text("<all><Patient><id>7</id></Patient></all>")
    assert T.documents_from_xml(spark, str(tmp_path / "b.xml"), "Patient").first().resource == '{"id":7}'


def test_escapes_are_read_once(spark):
    for text in ("a\\n", "\\\\n\n", 'q"\\', "", "&lt;&amp;lt;", "a&b<c>'"):
        for kind in ("json", "html"):
            assert value(spark, S.unescape(S.escape(F.lit(text), kind), kind)) == text
    assert value(spark, S.unescape(F.lit("\\\\n"), "json")) == "\\n"


def test_offsets_and_substrings_are_both_bytes(spark):
    x = F.lit("éab")
    assert value(spark, S.substring(x, 2)) == "ab" and value(spark, S.substring(x, 3, 1)) == "b" and value(spark, S.substring(x, 1, 1)) is None
    with pytest.raises(ValueError):
        S.substring(x, 0, -1)


def test_datetimes_and_times(spark):
    got = [str(value(spark, S.to_datetime(F.lit(x)))) for x in ("2020", "2020-02-03T04:05:06+01:00", "2020-02-03T04:05Z", "2020-13", "x")]
    assert got == ["2020-01-01 00:00:00", "2020-02-03 03:05:06", "2020-02-03 04:05:00", "None", "None"]
    assert value(spark, S.to_time(F.lit("T25:00"))) is None and value(spark, S.time_precision(F.lit("10:30:00.5"))) == 9
    assert value(spark, S.compare(F.lit("2020"), F.lit("2020-01"))) is None and value(spark, S.compare(F.lit(2), F.lit(1))) == 1


def test_json_patch_is_all_or_nothing(spark):
    docs = spark.createDataFrame([('{"a":[1,2],"b":{"c":1}}',), ('{"a":[]}',), (None,)], "resource string")
    steps = [{"op": "move", "from": "/a/0", "path": "/b/d~1e"}, {"op": "add", "path": "/a/-", "value": 3}, {"op": "copy", "from": "/b", "path": "/e"}]
    assert [r.resource for r in shape.json_patch(docs, steps).collect()] == ['{"a":[2,3],"b":{"c":1,"d/e":1},"e":{"c":1,"d/e":1}}', None, None]


def test_limits_guard():
    assert search.checked(count=20) == {"count": 20}
    for asked in ({"count": 1001}, {"iterate": -1}):
        with pytest.raises(ValueError):
            search.checked(**asked)
    with pytest.raises(ValueError):
        search.chain_target("unknown")


def test_canonical_versions_compare_as_numbers(spark):
    rows = spark.createDataFrame([("u", "1.10"), ("u", "1.9.1"), ("u", "1.2"), ("u", "x"), ("v", "1.9")], "canonical_url string, canonical_version string")
    assert [r.canonical_version for r in rows.where(search.canonical_is("u|1.9", "above")).collect()] == ["1.10", "1.9.1"]
    assert [r.canonical_version for r in rows.where(search.canonical_is("u|1.9", "below")).collect()] == ["1.2"]


def test_appended_versions_need_no_flags(spark):
    v = spark.createDataFrame([("P", "1", 1, False, "x"), ("P", "1", 2, False, "y"), ("P", "2", 1, False, "z")], "resource_type string, id string, version_id int, deleted boolean, status string")
    changes = spark.createDataFrame([("P", "1", True, None), ("P", "3", False, "n")], "resource_type string, id string, deleted boolean, status string")
    new = history.appended(v, changes)
    assert {(r.id, r.version_id) for r in new.collect()} == {("1", 3), ("3", 1)}
    assert {(r.id, r.status) for r in history.newest(v.unionByName(new)).collect()} == {("2", "z"), ("3", "n")}
