"""Schemas folded over records, deep merges, flat JSON, file copies, and the choice of a read."""

import datetime as dt
import hashlib
import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.operators import merging, schemas
from weirflow.plans import delegating
from weirflow.sources import transfer

JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False, width=16) | st.text(max_size=2), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from("abc"), v, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=5), st.randoms())
def test_nodes_meet_in_any_order_and_grouping(values, rng):
    nodes = [schemas.node_of(v) for v in values]
    whole = nodes[0]
    for n in nodes[1:]:
        whole = schemas.met(whole, n)
    again = nodes + [rng.choice(nodes)]
    rng.shuffle(again)
    while len(again) > 1:
        a, b = again.pop(rng.randrange(len(again))), again.pop(rng.randrange(len(again)))
        again.append(schemas.met(a, b))
    assert json.dumps(again[0], sort_keys=True) == json.dumps(whole, sort_keys=True)


def schema(spark, *records, keys=(), repeat=3):
    rows = [(json.dumps(r),) for r in records] * repeat + [("no json",), (None,)]
    random.Random(len(rows)).shuffle(rows)
    return schemas.record_schema(spark.createDataFrame(rows, "body string").repartition(5), "body", list(keys))


def test_record_schemas(spark):
    props = lambda *records: schema(spark, *records)["properties"]
    assert props({"field_A": 1.0}, {"field_A": "abc"}) == {"field_A": {"type": ["number", "string", "null"]}}
    assert props({"a": 1}, {"a": 2}, {"b": None}) == {"a": {"type": ["number", "null"]}}
    nested = props({"obj": {"data": [1.0, 2]}}, {"obj": {"other_key": "x", "data": [None, "y"]}}, {"obj": None})
    assert nested == {"obj": {"type": ["object", "null"], "properties": {"data": {"type": ["array", "null"], "items": {"type": ["number", "string", "null"]}}, "other_key": {"type": ["string", "null"]}}}}
    mixed = props({"a": {"x": 1}}, {"a": [True]}, {"a": "t"})["a"]["anyOf"]
    assert [f["type"] for f in mixed] == ["object", "array", "string", "null"] and mixed[1]["items"] == {"type": ["boolean", "null"]}
    assert props({"a": []}) == {"a": {"type": ["array", "null"]}}
    assert schemas.record_schema(spark.createDataFrame([("x",)], "body string"), "body") is None


def test_required_fields(spark):
    found = schema(spark, {"id": 1, "o": {"k": "x", "v": None}}, keys=[["id"], ["o", "k"]])
    assert found["required"] == ["id", "o"] and found["properties"]["id"] == {"type": "number"} and found["properties"]["o"] == {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]}
    for keys in ([["none"]], [["id", "deeper"]]):
        with pytest.raises(ValueError, match="no field"):
            schema(spark, {"id": 1}, keys=keys)


def test_places_by_key(spark):
    rows = [("x", 1, '{"a": [1, "s"]}'), ("x", 1, '{"a": {"b": true}}'), (None, 2, '{"a": null}')]
    got = {(r.k, r.path): r.kinds for r in schemas.places(spark.createDataFrame(rows, "k string, node int, body string"), "body", ["k"]).collect()}
    assert got == {("x", ""): ["object"], ("x", "a"): ["array", "object"], ("x", "a[]"): ["number", "string"], ("x", "a.b"): ["boolean"], (None, ""): ["object"], (None, "a"): ["null"]}


def test_deep_merges_of_structs(spark):
    a = spark.sql("SELECT 1 AS k, NAMED_STRUCT('x', 1, 'in', NAMED_STRUCT('p', 'old', 'q', 2)) AS s, ARRAY(1, 2) AS l, 5 AS n UNION ALL SELECT 2, NULL, NULL, NULL")
    b = spark.sql("SELECT 1 AS k, NAMED_STRUCT('in', NAMED_STRUCT('p', 'new', 'r', 3.5D), 'y', 'y') AS s, ARRAY(9) AS l, 'seven' AS n UNION ALL SELECT 3, NULL, ARRAY(3), NULL")
    c = spark.sql("SELECT 1 AS k, NAMED_STRUCT('in', NAMED_STRUCT('q', CAST(NULL AS INT))) AS s, DATE '2024-01-01' AS d")
    got = {r.k: r.asDict(recursive=True) for r in merging.merge_chunks([a, b, c], ["k"]).collect()}
    assert got[1] == {"k": 1, "s": {"x": 1, "in": {"p": "new", "q": 2, "r": 3.5}, "y": "y"}, "l": [9], "n": "seven", "d": dt.date(2024, 1, 1)}
    assert got[2]["s"] is None and got[3]["l"] == [3]


def test_deep_merges_of_rows(spark):
    rows = [("a", 2, {"v": None, "in": {"p": 2, "q": None}}), ("a", 1, {"v": "one", "in": {"p": 1, "q": 1}}), ("b", 1, None), (None, 1, {"v": "n", "in": None}), (None, 2, {"v": "m", "in": None})]
    df = spark.createDataFrame(rows, "k string, at int, s struct<v: string, in: struct<p: int, q: int>>")
    got = merging.merge_rows(df, ["k"], ["at"]).collect()
    assert sorted(((r.k, r["at"], r.s.asDict(recursive=True) if r.s else None) for r in got), key=repr) == sorted([("a", 2, {"v": "one", "in": {"p": 2, "q": 1}}), ("b", 1, None), (None, 1, {"v": "n", "in": None}), (None, 2, {"v": "m", "in": None})], key=repr)


def test_deep_merges_of_json(spark):
    pairs = [('{"a": {"x": 1, "y": [1]}, "b": 2}', '{"a": {"y": [2], "z": null}, "c": {"d": 1}}', {"a": {"x": 1, "y": [2], "z": None}, "b": 2, "c": {"d": 1}}), ('{"a": 1}', '{"a": {"b": 2}}', {"a": {"b": 2}}), ('{"a": 1}', None, {"a": 1}), (None, '{"b": 1}', {"b": 1}), ('{"a": 1}', "[3]", [3])]
    df = spark.createDataFrame([p[:2] for p in pairs], "l string, r string")
    assert [json.loads(r.m) for r in df.select(merging.merged_json(F.col("l"), F.col("r")).alias("m")).collect()] == [p[2] for p in pairs]


@pytest.mark.parametrize(
    ("lists", "record", "want"),
    [
        (True, {"NestedRecord": {"FirstName": "John", "LastName": "Doe"}, "456Another123": 456}, {"FirstName": "John", "LastName": "Doe", "456Another123": 456}),
        (True, {"ListExample": [{"A": "a"}, {"A": "b"}]}, {"ListExample.0.A": "a", "ListExample.1.A": "b"}),
        (True, {"MixedCase123": {"Nested": [{"Key": {"Value": "test1"}}, {"Key": {"Value": "test2"}}]}, "SimpleKey": "SimpleValue"}, {"Nested.0.Key.Value": "test1", "Nested.1.Key.Value": "test2", "SimpleKey": "SimpleValue"}),
        (True, {"List": ["Item1", "Item2", "Item3"]}, {"List.0": "Item1", "List.1": "Item2", "List.2": "Item3"}),
        (False, {"List": ["Item1", "Item2", "Item3"]}, {"List": ["Item1", "Item2", "Item3"]}),
        (False, {"RootField": {"List": [{"a": 1}, {"a": 2}]}, "List": [1, 3, 6], "SimpleKey": "SimpleValue"}, {"RootField.List": [{"a": 1}, {"a": 2}], "List": [1, 3, 6], "SimpleKey": "SimpleValue"}),
    ],
)
def test_flat_records(spark, lists, record, want):
    assert merging.flat(record, lists) == want
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "[1]"), (3, None), (4, "broken")], "k int, body string")
    rows = {r.k: r.asDict() for r in merging.flat_columns(df, "body", lists, keep=["k"]).collect()}
    assert rows[1] == {"k": 1, **{n: v if isinstance(v, str) else json.dumps(v) for n, v in want.items()}}
    assert all(v is None for k in (2, 3, 4) for n, v in rows[k].items() if n != "k")


def test_files_are_copied_whole(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    contents = {"a.bin": os.urandom(9_000_000), "sub/b.bin": b"", "sub/a.txt": b"text"}
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    done = transfer.transfer(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert {r.file_path: (r.bytes, r.sha256) for r in done} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    assert all((tmp_path / "out" / n).read_bytes() == d for n, d in contents.items())
    held = lambda where: sorted(f for _, _, names in os.walk(tmp_path / where) for f in names)
    assert held("out") == ["a.bin", "a.txt", "b.bin"]
    some = transfer.transfer(spark, str(tmp_path / "in"), str(tmp_path / "flat"), glob="*.bin", keep_folders=False)
    assert some.count() == 2 and held("flat") == ["a.bin", "b.bin"]
    with pytest.raises(ValueError, match="larger than 1000 bytes"):
        transfer.transfer(spark, str(tmp_path / "in"), str(tmp_path / "none"), limit=1000)
    (tmp_path / "in/sub/a.bin").write_bytes(b"again")
    with pytest.raises(ValueError, match="a name that another has"):
        transfer.transfer(spark, str(tmp_path / "in"), str(tmp_path / "none"), keep_folders=False)
    assert not (tmp_path / "none").exists() and transfer.transfer(spark, str(tmp_path / "nowhere"), str(tmp_path / "none")).count() == 0


def test_a_failed_copy_leaves_no_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"x" * 100)
    (tmp_path / "out/a.bin/in_the_way").mkdir(parents=True)
    with pytest.raises(Exception):
        transfer.transfer(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [n for _, _, names in os.walk(tmp_path / "out") for n in names] == [] and os.listdir(tmp_path / "out") == ["a.bin"]


def test_reads_are_chosen_by_the_age_of_the_state(spark, tmp_path):
    now, day = dt.datetime(2024, 3, 1), dt.timedelta(days=1)
    spark.sql("SELECT id, TIMESTAMP '2024-01-01' + MAKE_INTERVAL(0,0,0,CAST(id AS INT)) AS at FROM range(60)").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    state = lambda *cursors: spark.createDataFrame([(i, c) for i, c in enumerate(cursors)], "part int, cursor timestamp")
    choose = lambda s, **o: delegating.delegated(s, "cursor", lambda: table, lambda c: table.where(F.col("at") >= F.lit(c)), now=now, **o)
    for s, options in ((None, {}), (state(), {}), (state(now - 40 * day, now), {"retention": 30 * day}), (state(now, None), {})):
        rows, kind = choose(s, **options)
        assert kind == "full" and rows.count() == 60
    for options in ({}, {"retention": 30 * day}):
        rows, kind = choose(state(now - 10 * day, now), **options)
        assert kind == "incremental" and rows.count() == 10 and "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in rows._jdf.queryExecution().toString()
