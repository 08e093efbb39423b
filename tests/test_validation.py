"""Values against schemas."""

import json

import pytest

from weirflow.operators import validation

CONFIG = {
    "type": "object",
    "required": ["key", "start"],
    "additionalProperties": False,
    "properties": {
        "key": {"type": "string", "minLength": 2},
        "start": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"},
        "pages": {"type": ["integer", "null"], "minimum": 1, "exclusiveMaximum": 10},
        "kind": {"enum": ["a", 1]},
        "shops": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "number"}}}},
        "auth": {"oneOf": [{"required": ["token"]}, {"required": ["user"]}]},
        "any": {"anyOf": [{"type": "boolean"}, {"type": "string", "const": "x"}]},
    },
}


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ({}, []),
        ({"pages": None, "kind": 1, "shops": [{"id": 1.5}], "auth": {"user": 1}, "any": True}, []),
        ({"key": "k"}, ["$.key: minLength is 2"]),
        ({"start": "today"}, [r"$.start: pattern is ^\d{4}-\d{2}-\d{2}$"]),
        ({"pages": 10}, ["$.pages: exclusiveMaximum is 10"]),
        ({"pages": 0.5}, ["$.pages: not integer or null", "$.pages: minimum is 1"]),
        ({"pages": True}, ["$.pages: not integer or null"]),
        ({"kind": True}, ['$.kind: not one of ["a", 1]']),
        ({"shops": []}, ["$.shops: minItems is 1"]),
        ({"shops": [{"id": "1"}, {}]}, ["$.shops[0].id: not number", "$.shops[1].id: missing"]),
        ({"auth": {"user": 1, "token": 2}}, ["$.auth: fits 2 of the 2 forms of oneOf"]),
        ({"any": "y"}, ["$.any: fits 0 of the 2 forms of anyOf"]),
        ({"other": 1}, ["$.other: nothing is allowed here"]),
    ],
)
def test_configurations(more, want):
    assert sorted(validation.violations({"key": "kk", "start": "2024-01-01", **more}, CONFIG)) == sorted(want)
    assert validation.violations({}, CONFIG) == ["$.key: missing", "$.start: missing"] and validation.violations([], CONFIG) == ["$: not object"]


def test_records_of_a_table(spark):
    texts = [json.dumps({"key": "kk", "start": "2024-01-01"}), json.dumps({"key": 5, "start": "2024-01-01"}), "broken", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    assert [r.violations for r in validation.validated(df, "body", CONFIG).orderBy("i").collect()] == [[], ["$.key: not string"], ["$: not JSON"], None]
