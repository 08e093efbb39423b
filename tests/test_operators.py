"""Golden pairs of record operators, functions, slices and state."""

import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import dates, text, values
from weirflow.operators import filters, joins, loading, records, state
from weirflow.plans import incremental, slices


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("key", "want"),
    [
        ("orderDate", "order_date"), ("HTTPStatus code", "httpstatus_code"), ("2ndLine", "_2_nd_line"), ("tax%rate", "tax_rate"), ("Übergröße", "ubergrosse"),
        ("_hidden", "_hidden"), ("open_", "open_"), ("--both--", "_both_"), ("a__b", "a_b"), ("a__b_", "a_b_"), ("!", ""), ("7", "_7"), ("_7", "_7"), ("plain", "plain"),
    ],
)
def test_snake_keys(key, want):
    assert text.snake_key(key) == want


def test_nested_keys_are_renamed(spark):
    df = spark.createDataFrame([((("x",),),)], "`Ship To` struct<Addr: struct<ZipCode: string>>")
    assert records.keys_to_snake(df).schema.simpleString() == "struct<ship_to:struct<addr:struct<zip_code:string>>>"


def test_extract_json_tells_false_values(spark):
    bodies = ['{"k":"hello"}', '{"k":"0"}', '{"k":0}', '{"k":0.0}', '{"k":""}', '{"k":{}}', '{"k":[]}', '{"k":false}', '{"k":null}', "{}", "no json", '{"k":true}', '{"k":["a",null,0,{"x":1}]}', '{"k":{"x":2}}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = {}
    for r in records.extract_json(df, "b", "$.k", "string", "v").collect():
        got.setdefault(r.i, []).append(r.v)
    assert got == {0: ["hello"], 1: ["0"], 11: ["true"], 12: ["a", None, "0", '{"x":1}'], 13: ['{"x":2}']}
    nested = records.extract_json(df.where("i in (12, 13)"), "b", "$.k", "struct<x: int>", "v").where("v is not null")
    assert sorted(r.v.x for r in nested.collect()) == [1, 2]


def test_flatten_keeps_bare_names_until_they_clash(spark):
    df = spark.createDataFrame([((1, (2,)), 3)], "a struct<x: int, b: struct<y: int>>, x int")
    assert records.flatten(df).first().asDict() == {"x": 3, "y": 2, "a.x": 1}
    assert records.lift(df, "a", prefix="p_").columns == ["a", "x", "p_x", "p_b"]
    assert records.lift(df, "a").columns == ["a", "x"]


def test_add_fields_sees_earlier_ones(spark):
    df = spark.createDataFrame([("v",)], "k string")
    got = records.add_fields(df, [("n", "1", None), ("s", "n + 1", "string"), ("k", "'new'", None)]).first()
    assert got.asDict() == {"k": "new", "n": 1, "s": "2"}
    assert records.add_fields(df, [("k", "'x'", None)], when=F.col("k") == "other").first().k == "v"


def test_remove_fields(spark):
    df = spark.createDataFrame([((1, 2), 3)], "s struct<a: int, b: int>, c int")
    assert records.remove_fields(df, ["s.a", "c", "no"]).schema.simpleString() == "struct<s:struct<b:int>>"


def test_normalize_flags_what_does_not_fit(spark):
    df = spark.createDataFrame([("1", "x"), ("b", None)], "n string, s string")
    assert [tuple(r) for r in records.normalize(df, {"n": "bigint"}).select("n", "_cast_errors").collect()] == [(1, []), (None, ["n"])]


def test_truth(spark):
    for form in values.FALSE_FORMS:
        assert one(spark, values.truthy(F.lit(form)).alias("t")).t is False
    assert one(spark, values.truthy(F.lit("x")).alias("t")).t and one(spark, values.truthy(F.lit(None)).alias("t")).t
    js = spark.createDataFrame([('{"k":null}',), ("{}",), ('{"k":0}',), ('{"k":"a"}',)], "j string")
    assert [r.t for r in js.select(values.truthy_json(F.col("j"), "k").alias("t")).collect()] == [True, False, False, True]


def test_hashes(spark):
    got = one(spark, text.hmac_sha256(F.lit("message"), "key").alias("h"), text.digest(F.lit("a"), "sha1", "b").alias("d"), text.url_quote(F.lit("a b&c")).alias("u"))
    assert (got.h, got.d, got.u) == (hmac.new(b"key", b"message", "sha256").hexdigest(), hashlib.sha1(b"ab").hexdigest(), "a+b%26c")
    assert one(spark, text.hmac_sha256(F.lit("m"), "k" * 100).alias("h")).h == hmac.new(b"k" * 100, b"m", "sha256").hexdigest()
    assert one(spark, text.snake(F.lit("CamelCaseName")).alias("s")).s == "camel_case_name"


def test_dates(spark):
    parsed = dates.parse(F.lit("2021-02-03T04:05:06"), "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S")
    got = one(spark, dates.render(parsed, "%ms").alias("ms"), dates.render(parsed, "%Y/%m/%d").alias("d"), dates.parse(F.lit("1612325106"), "%s").alias("s"), dates.ceiling(parsed, "day").alias("c"))
    assert (got.ms, got.d, got.s.isoformat(), got.c.isoformat()) == ("1612325106000", "2021/02/03", "2021-02-03T04:05:06", "2021-02-04T00:00:00")


def test_conformance_and_policies(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',), ('{"a":"x"}',), ('{"a":null}',), ("bad",)], "r string")
    assert [r.f for r in df.select(filters.conforms(F.col("r"), {"a": "integer"}).alias("f")).collect()] == [True, False, False, True, False]
    assert filters.enforce(df, "r", {"a": "integer"}).count() == 2
    with pytest.raises(Exception, match="conform"):
        filters.enforce(df, "r", {"a": "integer"}, "stop").collect()


def test_schema_merge():
    a, b = T._parse_datatype_string("x bigint, y boolean"), T._parse_datatype_string("x double, z string")
    assert filters.merged_schema(a, b).simpleString() == "struct<x:double,y:boolean,z:string>"
    with pytest.raises(ValueError):
        filters.merged_schema(T._parse_datatype_string("x array<int>"), T._parse_datatype_string("x string"))


def test_property_chunks():
    names = list("abcdefg")
    assert [len(c) for c in slices.property_chunks(names, 2)] == [2, 2, 2, 1]
    assert slices.property_chunks(["w", "x", "y"], 2, always=["id", "at"]) == [["id", "at", "w", "x"], ["id", "at", "y"]]
    assert slices.property_chunks(["five5", "sixsix", "seven77"], 17, "characters") == [["five5", "sixsix"], ["seven77"]]


def test_grouping(spark):
    boards = slices.listed(spark, "board", [0, 1, 2, 3, 4, 0])
    assert [r["values"] for r in slices.grouped(boards, "board", ["position"], 2).orderBy("batch").collect()] == [[0, 1], [2, 3], [4]]


def test_product_and_union(spark):
    a, b = slices.listed(spark, "x", ["p", "q"]).drop("position"), slices.listed(spark, "y", [1, 2]).drop("position")
    assert slices.product(a, b).count() == 4 and slices.single(spark).count() == 1
    got = slices.union_first([slices.listed(spark, "k", ["a", "b"]), slices.listed(spark, "k", ["b", "c"])], "k").collect()
    assert {(r.k, r.child) for r in got} == {("a", 0), ("b", 0), ("c", 1)}


def test_chunk_merge_keeps_rows_without_a_key(spark):
    one_ = spark.createDataFrame([(1, "a"), (None, "loose")], "k int, x string")
    two = spark.createDataFrame([(1, "b", 5), (2, None, 6)], "k int, x string, y int")
    got = {tuple(r) for r in joins.merge_chunks([one_, two], ["k"]).collect()}
    assert got == {(1, "b", 5), (2, None, 6), (None, "loose", None)}


def test_file_history(spark):
    files = spark.createDataFrame([("a", 1), ("b", 5), ("c", 2)], "uri string, last_modified int")
    history = spark.createDataFrame([("a", 1), ("b", 4)], "uri string, last_modified int")
    assert {r.uri for r in joins.pending_files(files, history).collect()} == {"b", "c"}
    assert {r.uri for r in state.evict(files, 2).collect()} == {"b", "c"}


def test_state_shapes(spark):
    df = spark.createDataFrame([([(1, 5, None)],), ([],)], "s array<struct<start: int, end: int, most_recent: int>>")
    assert [r.s for r in df.select(state.start_from_state(F.col("s"), F.lit(9), F.lit(0)).alias("s")).collect()] == [5, 9]
    got = one(spark, state.legacy_to_partitions(F.create_map(F.lit("p"), F.lit(7)), "id", "c").alias("s")).s
    assert [(r.partition, r.cursor) for r in got] == [({"id": "p"}, {"c": 7})]


def test_cursors_and_routes_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 1, 7), (None, 1, 3)], "p string, q int, c int")
    got = {(r.p, r.q, r.is_global): r.cursor for r in state.max_cursor(df, ["p", "q"], "c").collect()}
    assert got == {("a", 1, False): 5, ("a", 2, False): 9, ("b", 1, False): 7, (None, 1, False): 3, (None, None, True): 9}
    assert [r.route for r in filters.route_deletes(df, F.col("p") == "a").orderBy("c").collect()] == ["load", "delete", "load", "delete"]


def test_keys_without_intervals_are_read_whole(spark):
    merged = spark.createDataFrame([("a", 3, 5)], "k string, start long, end long")
    every = spark.createDataFrame([("a",), ("b",)], "k string")
    got = sorted(tuple(r) for r in slices.unsynced(merged, ["k"], F.lit(0).cast("long"), F.lit(9).cast("long"), every=every).collect())
    assert got == [("a", 0, 2), ("a", 5, 9), ("b", 0, 9)]


def test_status_rollup(spark):
    rows = [(1, "completed"), (1, "skipped"), (2, "skipped"), (3, "failed"), (3, "running"), (4, "running"), (4, "completed"), (5, "timed_out"), (5, "running")]
    got = {r.k: r.status for r in state.rollup_status(spark.createDataFrame(rows, "k int, s string"), ["k"], "s").collect()}
    assert got == {1: "completed", 2: "skipped", 3: "failed", 4: "running", 5: "timed_out"}


def test_inferred_types(spark):
    for column, want in ((["7", "-12000"], "integer"), (["true", "no"], "boolean"), (["4", "0.25"], "number"), (["1", None], "boolean"), (["[1]"], "string"), ([None], "string")):
        df = spark.createDataFrame([(v,) for v in column], "v string")
        assert df.agg(state.inferred_type(F.col("v")).alias("t")).first().t == want


def test_loading(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in loading.merge(target, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    twice = spark.createDataFrame([(2, "c"), (2, "x"), (2, None), (None, "n"), (None, "n")], "k int, v string")
    assert sorted(loading.merge(target, twice, ["k"], F.col("v")).collect(), key=str) == [(1, "a"), (2, "x"), (None, "n"), (None, "n")]
    with pytest.raises(ValueError):
        loading.merge(target, new, [])
    loading.swap(new, "swapped")
    loading.swap(target, "swapped")
    assert spark.table("swapped").count() == 2
    words = spark.createDataFrame([(1, "a b c d e f g"), (2, " "), (3, None), (4, "x")], "k int, t string")
    assert [(r.k, r.content) for r in loading.chunks(words, "t", 4, 1, ["k"]).orderBy("k", "chunk").collect()] == [(1, "a b c d"), (1, "d e f g"), (4, "x")]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6)), min_size=1, max_size=12))
def test_intervals_cover_the_same_points_and_merging_is_idempotent(spark, spans):
    df = spark.createDataFrame([(1, a, a + n) for a, n in spans], "k int, start long, end long")
    merged = state.merge_intervals(df, ["k"], step=1)
    rows = sorted((r.start, r["end"]) for r in merged.collect())
    assert {p for a, b in rows for p in range(a, b + 1)} == {p for a, n in spans for p in range(a, a + n + 1)}
    assert all(b[0] > a[1] + 1 for a, b in zip(rows, rows[1:]))
    assert sorted((r.start, r["end"]) for r in state.merge_intervals(merged, ["k"], step=1).collect()) == rows
    gaps = [(r.start, r["end"]) for r in slices.unsynced(merged, ["k"], F.lit(-3).cast("long"), F.lit(60).cast("long")).collect()]
    assert {p for a, b in gaps for p in range(a, b + 1)} >= set(range(-3, 61)) - {p for a, b in rows for p in range(a, b + 1)}


def test_general_times_and_durations(spark):
    for value, want in (("2021-05-06", "2021-05-06T00:00:00"), ("2021-05-06T07:08:09.5+02:00", "2021-05-06T05:08:09.500000"), ("1620284889", "2021-05-06T07:08:09"), ("soon", None), (None, None)):
        got = one(spark, dates.parse_any(F.lit(value)).alias("t")).t
        assert (got and got.isoformat()) == want
    start = F.lit("2020-01-31 00:00:00").cast("timestamp")
    for value, want in (("P1M", "2020-02-29T00:00:00"), ("P1Y2M3DT4H5M6.5S", "2021-04-03T04:05:06.500000"), ("PT36H", "2020-02-01T12:00:00"), ("P2W", "2020-02-14T00:00:00"), ("P", None), ("PT", None), ("1D", None)):
        got = one(spark, (start + dates.duration(F.lit(value))).alias("t")).t
        assert (got and got.isoformat()) == want


def test_globs_name_fields(spark):
    df = spark.createDataFrame([((1, (2, 3)), 4, 5)], "s struct<a: int, t: struct<a: int, b: int>>, tmp_x int, y int")
    assert records.remove_fields(df, ["tmp_*", "**.a"]).schema.simpleString() == "struct<s:struct<t:struct<b:int>>,y:int>"
    assert records.matching(df.schema, "s.*.b") == ["s.t.b"] and records.matching(df.schema, "none*") == []


@settings(max_examples=10, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=60), st.integers(3, 12))
def test_chunks_lose_nothing_and_fit(spark, body, size):
    df = spark.createDataFrame([(1, body)], "k int, t string")
    for kind in ("lines", "markdown", "paragraphs"):
        got = [r.content for r in loading.split_chunks(df, "t", size, kind, ["k"]).orderBy("chunk").collect()]
        assert "".join(got) == body and all(0 < len(c) <= size for c in got)


def test_markdown_and_code_part_at_heads(spark):
    df = spark.createDataFrame([("# a\nx\n## b\ny\n",), ("import x\ndef f():\n  1\nclass C:\n  2\n",)], "t string")
    heads = [r.content for r in loading.split_chunks(df, "t", 9, "markdown").collect()]
    assert heads[:2] == ["# a\nx\n", "## b\ny\n"]
    assert [r.content for r in loading.split_chunks(df, "t", 20, "python").collect()][-3:] == ["import x\n", "def f():\n  1\n", "class C:\n  2\n"]


def test_snake_keys_of_several_scripts(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Gr\u00f6\u00dfe", "\u0416", "\u65e5\u672c"])
    assert records.keys_to_snake(df).columns == ["grosse", "zh", text.snake_key("\u65e5\u672c")] and text.snake_key("\u65e5") != text.snake_key("\u672c")
    with pytest.raises(ValueError, match="told apart"):
        records.keys_to_snake(spark.createDataFrame([(1, 2)], ["aB", "a_b"]))
    with pytest.raises(ValueError, match="told apart"):
        records.keys_to_snake(spark.createDataFrame([(1,)], ["--"]))


def test_sync_reads_no_record_twice_and_keeps_null_partitions(spark):
    state = spark.createDataFrame([("a", 0, 49), ("a", 100, 102)], "k string, start long, end long")
    rows = spark.createDataFrame([("a", 95), ("a", 60), ("a", 101), (None, 7), ("a", None), (None, None)], "k string, at long")
    parts = spark.createDataFrame([(None,), ("a",)], "k string")
    got, after = incremental.sync(rows, state, ["k"], "at", F.lit(0).cast("long"), F.lit(1000).cast("long"), lookback=10, partitions=parts)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert sorted(map(tuple, after.select("k", "start", "end").collect()), key=repr) == [("a", 0, 1000), (None, 0, 1000)]


def test_hashes_of_nested_values(spark):
    def plain(v):
        """The hash of a Python value."""
        if isinstance(v, dict):
            shown = str(sorted((k, plain(x)) for k, x in v.items()))
        else:
            shown = str([plain(x) for x in v]) if isinstance(v, list) else str(v)
        return hashlib.sha256(("seed" + shown).encode()).hexdigest()

    kind = "v struct<b: array<map<string, int>>, a: string, c: struct<x: boolean, y: array<string>>, n: int>"
    values_ = [{"b": [{"k": 1, "it's": 2}, {}], "a": "é", "c": {"x": True, "y": ["p", None]}, "n": None}, {"b": None, "a": None, "c": None, "n": -5}]
    df = spark.createDataFrame([(v,) for v in values_], kind)
    got = [r.h for r in df.select(text.one_way_hash_of(F.col("v"), df.schema["v"].dataType, "seed").alias("h")).collect()]
    assert got == [plain(v) for v in values_]


def test_base64_of_ascii(spark):
    assert one(spark, text.base64_ascii(F.lit("user:pass")).alias("s")).s == "dXNlcjpwYXNz" and one(spark, text.base64_ascii(F.lit(None).cast("string")).alias("s")).s is None
    with pytest.raises(Exception, match="not ASCII"):
        one(spark, text.base64_ascii(F.lit("\u00e9")).alias("s"))
