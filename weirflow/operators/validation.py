"""Values against JSON schemas, nested ones too: records of a table, and configurations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Check = Callable[[object, str], Iterator[str]]

#: JSON's kinds by what Python has for them; truth is no number.
KINDS: dict[str, Callable[[object], bool]] = {
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def compiled(schema: dict | bool) -> Check:
    """A function that gives what is wrong with a value, each with its path, for a schema that is looked at once."""
    if isinstance(schema, bool):
        return lambda v, at: iter(()) if schema else iter([f"{at}: nothing is allowed here"])
    checks: list[Check] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        checks.append(lambda v, at: iter(()) if any(KINDS[k](v) for k in kinds) else iter([f"{at}: not {' or '.join(kinds)}"]))
    if "enum" in schema or "const" in schema:
        allowed = schema.get("enum", [schema.get("const")])
        same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
        checks.append(lambda v, at: iter(()) if any(same(v, x) for x in allowed) else iter([f"{at}: not one of {json.dumps(allowed)}"]))
    bounds = {
        "minimum": (float, lambda v, b: v >= b), "maximum": (float, lambda v, b: v <= b), "exclusiveMinimum": (float, lambda v, b: v > b), "exclusiveMaximum": (float, lambda v, b: v < b),
        "minLength": (str, lambda v, b: len(v) >= b), "maxLength": (str, lambda v, b: len(v) <= b), "pattern": (str, lambda v, b: re.search(b, v) is not None),
        "minItems": (list, lambda v, b: len(v) >= b), "maxItems": (list, lambda v, b: len(v) <= b),
    }
    for name in bounds.keys() & schema.keys():
        kind, fine = bounds[name]

        def bound(v: object, at: str, kind=kind, fine=fine, limit=schema[name], name=name) -> Iterator[str]:
            if (KINDS["number"](v) if kind is float else isinstance(v, kind)) and not fine(v, limit):
                yield f"{at}: {name} is {limit}"

        checks.append(bound)
    if {"properties", "required", "additionalProperties"} & schema.keys():
        fields = {k: compiled(s) for k, s in schema.get("properties", {}).items()}
        others, needed = compiled(schema.get("additionalProperties", True)), schema.get("required", [])

        def members(v: object, at: str) -> Iterator[str]:
            if isinstance(v, dict):
                yield from (f"{at}.{k}: missing" for k in needed if k not in v)
                for k, x in v.items():
                    yield from fields.get(k, others)(x, f"{at}.{k}")

        checks.append(members)
    if "items" in schema:
        item = compiled(schema["items"])

        def elements(v: object, at: str) -> Iterator[str]:
            if isinstance(v, list):
                for i, x in enumerate(v):
                    yield from item(x, f"{at}[{i}]")

        checks.append(elements)
    for name, fine in (("anyOf", lambda n, of: n > 0), ("oneOf", lambda n, of: n == 1), ("allOf", lambda n, of: n == of)):
        if name in schema:
            forms = [compiled(s) for s in schema[name]]

            def several(v: object, at: str, forms=forms, fine=fine, name=name) -> Iterator[str]:
                met = sum(next(f(v, at), None) is None for f in forms)
                if not fine(met, len(forms)):
                    yield f"{at}: fits {met} of the {len(forms)} forms of {name}"

            checks.append(several)
    return lambda v, at: (e for check in checks for e in check(v, at))


def violations(value: object, schema: dict) -> list[str]:
    """What is wrong with a value, such as a configuration; none if it conforms."""
    return list(compiled(schema)(value, "$"))


def validated(df: DataFrame, column: str, schema: dict, into: str = "violations") -> DataFrame:
    """The rows with an array of what is wrong with a column of JSON text: empty if it conforms, null for a null; text that isn't JSON is wrong as a whole."""
    kind = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = compiled(schema)

        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            try:
                return list(check(json.loads(text), "$"))
            except ValueError:
                return ["$: not JSON"]

        for batch in batches:
            found = pa.array([one(t) for t in batch.column(column).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, into])

    return df.mapInArrow(run, kind)
