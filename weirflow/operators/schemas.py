"""Schemas of records whose shape isn't known: a lattice of types, folded over all records in tasks.

A node says which kinds of values were seen at a place, what the fields of its objects and what the elements of
its lists are. Two nodes meet in one that holds both, whatever their order and however often, so parts of a
table are folded by tasks, then in buckets, then into one node a key; what is sent grows with the schema, not
with the records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: JSON's scalar kinds by Python's, whole numbers being numbers.
KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string"}


def node_of(value: object) -> dict:
    """The node of one value: ``kinds``, and ``object`` (by field) and ``array`` where it is one."""
    if isinstance(value, dict):
        return {"kinds": [], "object": {k: node_of(v) for k, v in value.items()}}
    if isinstance(value, list):
        out: dict = {"kinds": []}
        for v in value:
            out = met(out, node_of(v))
        return {"kinds": [], "array": out}
    return {"kinds": [KINDS[type(value)]]}


def met(a: dict, b: dict) -> dict:
    """The node that holds both."""
    out: dict = {"kinds": sorted({*a["kinds"], *b["kinds"]})}
    if "object" in a or "object" in b:
        left, right = a.get("object", {}), b.get("object", {})
        out["object"] = {k: met(left[k], right[k]) if k in left and k in right else left.get(k) or right[k] for k in sorted({*left, *right})}
    if "array" in a or "array" in b:
        out["array"] = met(a["array"], b["array"]) if "array" in a and "array" in b else a.get("array") or b["array"]
    return out


def json_schema(node: dict, root: bool = True) -> dict:
    """A node as a JSON schema: everything but the root may be null, places that only ever were null are left out."""
    kinds = [k for k in node["kinds"] if k != "null"]
    forms: list[dict] = []
    if "object" in node:
        fields = {k: json_schema(n, False) for k, n in node["object"].items()}
        forms.append({"type": "object", "properties": {k: s for k, s in fields.items() if s != {"type": ["null"]}}})
    if "array" in node:
        items = json_schema(node["array"], False)
        forms.append({"type": "array"} | ({"items": items} if items != {"type": ["null"]} else {}))
    if root:
        return forms[0] if len(forms) == 1 and not kinds else {"anyOf": forms + [{"type": k} for k in kinds]}
    if len(forms) + bool(kinds) > 1:
        return {"anyOf": [*forms, *([{"type": kinds if len(kinds) > 1 else kinds[0]}] if kinds else []), {"type": "null"}]}
    if forms:
        return forms[0] | {"type": [forms[0]["type"], "null"]}
    return {"type": [*kinds, "null"]}


def required(schema: dict, keys: list[list[str]]) -> dict:
    """A JSON schema in which the fields at the paths ``keys`` are required and not null, and so is what they lie in."""
    out = json.loads(json.dumps(schema))
    for path in keys:
        node = out
        for i, name in enumerate(path):
            if name not in node.get("properties", {}):
                raise ValueError(f"no field {'.'.join(path[: i + 1])} that could be required")
            node["required"] = [*node.get("required", []), *([] if name in node.get("required", []) else [name])]
            node = node["properties"][name]
            if "anyOf" in node:
                raise ValueError(f"{'.'.join(path[: i + 1])} has several types and can't be required")
            kinds = [k for k in node["type"] if k != "null"] if isinstance(node["type"], list) else [node["type"]]
            node["type"] = kinds[0] if len(kinds) == 1 else kinds
    return out


def folded(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """``keys`` and ``node``, JSON, the node of all records (a column of JSON text) of a key; text that isn't JSON is left out."""
    names = [f"__k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {df.select(k).dtypes[0][1]}" for n, k in zip(names, keys))
    shape = ", ".join(filter(None, [kinds, "task int, node string"]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple, dict] = {}
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(n) for n in names), ("task", pa.int32()), ("node", pa.string())])
            for key, text in zip(zip(*(batch.column(n).to_pylist() for n in names)) if names else [()] * batch.num_rows, batch.column("__body").to_pylist()):
                try:
                    node = node_of(json.loads(text))
                except (TypeError, ValueError):
                    continue
                held[key] = met(held[key], node) if key in held else node
        task = TaskContext.get().partitionId()
        rows = [{**dict(zip(names, k)), "task": task, "node": json.dumps(n)} for k, n in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = json.loads(rows["node"].iloc[0])
        for text in rows["node"].iloc[1:]:
            whole = met(whole, json.loads(text))
        return rows.iloc[:1].assign(node=json.dumps(whole))

    parts = df.select(*(F.col(k).alias(n) for n, k in zip(names, keys)), F.col(column).alias("__body")).mapInArrow(fold, shape)
    fan = max(2, isqrt(df.rdd.getNumPartitions()))
    parts = parts.withColumn("task", (F.col("task") % fan).cast("int")).groupBy(*names, "task").applyInPandas(merge, shape)
    parts = parts.withColumn("task", F.lit(0)).groupBy(*names, "task").applyInPandas(merge, shape)
    return parts.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "node")


def record_schema(df: DataFrame, column: str, keys: list[list[str]] = ()) -> dict | None:
    """The JSON schema of all records in a column of JSON text; None without any."""
    found = folded(df, column).first()
    return required(json_schema(json.loads(found.node)), list(keys)) if found else None


def places(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """``keys``, ``path`` and ``kinds`` of each place in the records: dotted, ``[]`` for elements; kinds sorted, objects and lists among them."""

    def rows(node: dict, path: str) -> Iterator[tuple[str, list[str]]]:
        kinds = node["kinds"] + [k for k in ("object", "array") if k in node]
        yield path, sorted(kinds)
        for name, inner in node.get("object", {}).items():
            yield from rows(inner, f"{path}.{name}" if path else name)
        if "array" in node:
            yield from rows(node["array"], f"{path}[]")

    @F.udf("array<struct<path: string, kinds: array<string>>>")  # one call a key
    def listed(node: str) -> list[tuple[str, list[str]]]:
        return list(rows(json.loads(node), ""))

    return folded(df, column, keys).select(*keys, F.explode(listed("node")).alias("p")).select(*keys, "p.path", "p.kinds")
