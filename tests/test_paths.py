"""Wildcard paths against a plain walk of the rows as Python values."""

import json

import pytest
from pyspark.sql import functions as F

from weirflow.operators import paths

KIND = """shop struct<name: string, depots: array<struct<id: int, stock: array<struct<sku: string, n: int, tags: array<string>>>>>, notes: map<string, struct<text: string, by: string>>>,
    other struct<name: string, x: struct<name: string, y: int>>, list array<int>, deep struct<a: struct<b: array<struct<name: string, k: array<array<int>>>>>>"""
ROWS = [
    {"shop": {"name": "s1", "depots": [{"id": 1, "stock": [{"sku": "a", "n": 1, "tags": ["t", "u"]}, {"sku": "b", "n": 2, "tags": []}]}, {"id": 2, "stock": None}], "notes": {"n1": {"text": "x", "by": "me"}, "m": {"text": "y", "by": "you"}}},
     "other": {"name": "o", "x": {"name": "ox", "y": 7}}, "list": [4, 5, 6], "deep": {"a": {"b": [{"name": "d", "k": [[1, 2], [3]]}]}}},
    {"shop": None, "other": {"name": None, "x": None}, "list": [], "deep": None},
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, KIND)


def walk(value, steps):
    """What a path gives of plain values, nulls left out."""
    if not steps:
        return [] if value is None else [value]
    pairs = list(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else []
    step, rest = steps[0], steps[1:]
    if step == "**":
        return (walk(value, rest) if rest else []) + [x for _, v in pairs for x in ([v] if not rest and v is not None else []) + walk(v, steps)]
    return [x for k, v in pairs if paths.fnmatchcase(k, step) for x in walk(v, rest)]


def plain(v):
    return v.asDict(recursive=True) if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize(
    "path",
    ["shop.name", "shop.depots.*.id", "shop.depots.*.stock.*.sku", "shop.depots.*.stock.*.tags.*", "shop.depots.0.stock.1.n", "shop.depots.9.id", "shop.notes.*.text", "shop.notes.n*.by", "shop.notes.m.text", "*.name", "list.*", "list.2", "o*.x.y",
     "deep.a.b.*.k.*.*", "**.name", "**.sku", "shop.**.n", "no.such", "list.x", "deep.**.k.0.1", "shop.depots"],
)
def test_values(df, path):
    got = [sorted(map(str, map(plain, r.v))) for r in df.select(paths.values_at(df, path).alias("v")).collect()]
    assert got == [sorted(map(str, walk(r, path.split(".")))) for r in ROWS]


def test_values_of_several_types_are_text(df):
    assert df.select(paths.values_at(df, "other.*").alias("v")).first().v == ["o", '{"name":"ox","y":7}']
    every = df.select(paths.values_at(df, "deep.**").alias("v")).first().v
    assert json.loads(every[0]) == {"b": [{"name": "d", "k": [[1, 2], [3]]}]} and "d" in every and "3" in every


def test_extract_and_expand(df):
    assert [r.record for r in paths.extract_at(df, "list").collect()] == [4, 5, 6]
    assert [plain(r.record) for r in paths.extract_at(df, "shop.depots.*.stock").collect()] == [ROWS[0]["shop"]["depots"][0]["stock"]]
    assert [plain(r.record)["sku"] for r in paths.expand_at(df, "shop.depots.*.stock").collect()] == ["a", "b"]
    rows = paths.expand_at(df, "shop.depots.*.stock.*.tags", "tag", emit_parent=True, original="was").collect()
    assert [r.tag for r in rows] == ["t", "u", None] and rows[0].was.other.name == "o"
    assert paths.expand_at(df, "shop.name").collect() == [] and paths.extract_at(df, "no.*").collect() == []


def without(value, steps):
    """A plain value without what lies at a path; elements of lists stay."""
    if isinstance(value, list):
        return [without(v, steps if steps[0] == "**" else steps[1:]) if steps[0] == "**" or steps[1:] and steps[0] in ("*", str(i)) else v for i, v in enumerate(value)]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        if steps[0] == "**":
            if steps[1:] and paths.fnmatchcase(k, steps[1]):
                if not steps[2:]:
                    continue
                v = without(v, steps[2:])
            v = without(v, steps)
        elif paths.fnmatchcase(k, steps[0]):
            if not steps[1:]:
                continue
            v = without(v, steps[1:])
        out[k] = v
    return out


@pytest.mark.parametrize("path", ["shop.depots.*.stock.*.n", "shop.depots.*.stock", "shop.notes.*.by", "shop.notes.n1", "shop.notes.n*", "other.x.name", "*.name", "**.name", "**.k", "list", "list.0", "no.such", "shop.depots.*.none", "deep.a.b.*.k.0"])
def test_remove(df, path):
    assert plain(paths.remove_at(df, path).first()) == without(ROWS[0], path.split("."))
    assert paths.remove_at(df, path).count() == 2


def test_remove_through_one_place_becomes_null_and_all_fields_go(df):
    first = plain(paths.remove_at(df, "shop.depots.0.id", "shop.notes.m.by").first())["shop"]
    assert [d["id"] for d in first["depots"]] == [None, 2] and first["notes"]["m"] == {"text": "y", "by": None} and first["notes"]["n1"]["by"] == "me"
    assert paths.remove_at(df, "other.*").columns == ["shop", "list", "deep"] and paths.remove_at(df, "**").columns == []


def test_change_and_set(df):
    louder = lambda v, k: F.upper(v)
    first = plain(paths.change_at(df, "shop.depots.*.stock.*.tags.*", louder).first())
    assert [s["tags"] for s in first["shop"]["depots"][0]["stock"]] == [["T", "U"], []] and first["list"] == [4, 5, 6]
    assert plain(paths.change_at(df, "**.name", louder).first())["deep"]["a"]["b"][0]["name"] == "D"
    assert plain(paths.change_at(df, "list.1", lambda v, k: v * 10).first())["list"] == [4, 50, 6]
    assert plain(paths.change_at(df, "shop.notes.n*.text", louder).first())["shop"]["notes"]["n1"]["text"] == "X"
    rows = paths.set_at(paths.set_at(paths.set_at(df, "other.x.z.w", F.lit(1)), "list.4", F.lit(9)), "shop.notes.new.by", F.lit("z")).collect()
    assert rows[0].other.x.z.w == 1 and [r["list"] for r in rows] == [[4, 5, 6, None, 9], [None, None, None, None, 9]]
    assert rows[0].shop.notes["new"].by == "z"
    assert paths.set_at(df, "fresh.a", F.lit("v")).first().fresh.a == "v"
    with pytest.raises(ValueError):
        paths.set_at(df, "a.*", F.lit(1))


def test_lift(df):
    assert paths.lift_at(df, "other.x").columns == ["shop", "other", "list", "deep", "name", "y"]
    assert paths.lift_at(df, "*.x", drop=True, prefix="p_").select("p_y", "other.*").columns == ["p_y", "name"]
    assert paths.lift_at(df, "**.x", only=True, suffix="_s").first().asDict() == {"name_s": "ox", "y_s": 7}
    assert paths.lift_at(df.withColumn("y", F.lit(1)), "other.x").columns == [*df.columns, "y"] and paths.lift_at(df, "list").columns == df.columns


@pytest.mark.parametrize("path", ["shop.name", "shop.depots.*.id", "shop.depots.*.stock.*.tags.*", "shop.depots.0.stock.1.n", "shop.n*.*.text", "*.name", "list.2", "no.such", "**.name", "**.k.0.1"])
def test_variants(spark, path):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)] + [(7, "broken"), (8, None)], "i int, body string")
    got = sorted((r.i, r.t) for r in paths.variant_values(df, "body", path, depth=7).select("i", F.to_json("value").alias("t")).collect() if r.t != "null")
    assert [(i, json.loads(t)) for i, t in got] == sorted(((i, v) for i, r in enumerate(ROWS) for v in walk(r, path.split("."))), key=lambda p: (p[0], json.dumps(p[1])))
    with pytest.raises(ValueError):
        paths.variant_values(df, "body", "**.x")
