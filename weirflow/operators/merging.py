"""Deep merges: of structs as expressions, of rows of one key, of chunks of records, of JSON text; and flat JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a merge: structs hold the fields of both, ``a``'s first; else ``b``'s type."""
    if not (isinstance(a, T.StructType) and isinstance(b, T.StructType)):
        return b
    right = {f.name: f for f in b.fields}
    fields = [T.StructField(f.name, merged_type(f.dataType, right[f.name].dataType) if f.name in right else f.dataType) for f in a.fields]
    return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in a.fieldNames()])


def merged(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """``a`` with the values of ``b`` put over it, struct by struct; a null of ``b`` leaves what ``a`` has.

    Values that aren't structs on both sides are replaced whole, lists too. Where the two have different
    types the result has that of ``b``, and what ``a`` has is cast to it, null if it doesn't fit.
    """
    if not (isinstance(kind_a, T.StructType) and isinstance(kind_b, T.StructType)):
        simple = not isinstance(kind_a, T.StructType | T.ArrayType | T.MapType) and not isinstance(kind_b, T.StructType | T.ArrayType | T.MapType)
        return F.coalesce(b, a) if kind_a == kind_b else F.coalesce(b, a.try_cast(kind_b)) if simple else b
    left, right = {f.name: f.dataType for f in kind_a.fields}, {f.name: f.dataType for f in kind_b.fields}
    parts = []
    for f in merged_type(kind_a, kind_b).fields:
        if f.name in left and f.name in right:
            value = merged(a.getField(f.name), left[f.name], b.getField(f.name), right[f.name])
        else:
            value = (a if f.name in left else b).getField(f.name)
        parts.append(value.alias(f.name))
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(*parts))


def nullable(kind: T.DataType) -> T.DataType:
    """A type all of whose fields may be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    return T.MapType(kind.keyType, nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


def merge_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: its rows put over each other in order, deeply, later ones last. A null key is no key: its rows stay as they are.

    The rows of a key (the chunks of a record) meet in one list.
    """
    names = [c for c in df.columns if c not in keys]
    kind = nullable(T.StructType([df.schema[c] for c in names]))
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    packed = F.struct(F.struct(*order).alias("o"), F.struct(*names).alias("r"))
    rows = df.where(whole).groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("rows"))
    first, rest = F.element_at("rows", 1)["r"].cast(kind), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    out = F.aggregate(rest, first, lambda acc, x: merged(acc, kind, x["r"], kind).cast(kind))
    return rows.select(*keys, out.alias("__r")).select(*keys, "__r.*").select(*df.columns).unionByName(df.where(~whole))


def merge_chunks(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Records whose fields came in chunks, joined on their keys and put over each other deeply, later chunks last."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.select(*(F.col(f"`{c}`").alias(f"__b_{c}") for c in b.columns))
        met = a.join(right, reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__b_{k}") for k in keys]), "full_outer")
        out = [F.coalesce(k, f"__b_{k}").alias(k) for k in keys]
        for c in [*a.columns, *(c for c in b.columns if c not in a.columns)]:
            if c in keys:
                continue
            if c in a.columns and c in b.columns:
                value = merged(F.col(f"`{c}`"), a.schema[c].dataType, F.col(f"`__b_{c}`"), b.schema[c].dataType)
            else:
                value = F.col(f"`{c}`" if c in a.columns else f"`__b_{c}`")
            out.append(value.alias(c))
        return met.select(*out)

    return reduce(both, chunks)


def over(a: object, b: object) -> object:
    """JSON values: ``b`` over ``a``, object by object; an explicit null of ``b`` counts."""
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return b
    return {**a, **{k: over(a[k], v) if k in a else v for k, v in b.items()}}


def merged_json(a: Column, b: Column) -> Column:
    """Two columns of JSON text merged as objects; where one is null or no object the other stays, ``b`` first."""

    @F.pandas_udf("string")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            try:
                p, q = (None if t is None else json.loads(t) for t in (x, y))
            except ValueError:
                return y if y is not None else x
            return json.dumps(over(p, q)) if isinstance(p, dict) and isinstance(q, dict) else y if y is not None else x

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="object")

    return run(a, b)


def flat(record: dict, lists: bool = True) -> dict:
    """The leaves of a record by flat names.

    Later fields come first. A leaf has its bare name unless that is taken or a list was met, from where
    on names hold the whole path below the last bare one; elements are named by their place.
    """
    out: dict = {}
    long = False

    def below(value: object, name: str) -> None:
        nonlocal long
        if isinstance(value, dict):
            inner = [(v, f"{name}.{k}" if long or k in out else k) for k, v in value.items()]
        elif lists and isinstance(value, list):
            long = long or bool(value)
            inner = [(v, f"{name}.{i}") for i, v in enumerate(value)]
        else:
            out[name] = value
            return
        for v, n in reversed(inner):
            below(v, n)

    below(record, "_")
    return out


def flat_json(df: DataFrame, column: str, lists: bool = True, into: str = "flat") -> DataFrame:
    """The rows with a map from flat name to JSON text of the leaf, of a column of JSON text; what is no object has none."""
    kind = T.StructType([*df.schema.fields, T.StructField(into, T.MapType(T.StringType(), T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for text in batch.column(column).to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                maps.append([(k, json.dumps(v)) for k, v in flat(record, lists).items()] if isinstance(record, dict) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.map_(pa.string(), pa.string()))], [*batch.schema.names, into])

    return df.mapInArrow(run, kind)


def flat_columns(df: DataFrame, column: str, lists: bool = True, keep: list[str] = ()) -> DataFrame:
    """The leaves of a column of JSON records as columns of text, found in a pass over all records; texts without quotes, other values as JSON.

    There is a column a name, so records with keys of their own or very long lists make wide tables.
    """
    rows = flat_json(df, column, lists, "__flat")
    names = sorted(r.name for r in rows.select(F.explode(F.map_keys("__flat")).alias("name")).distinct().collect())  # a row a column
    value = lambda n: F.try_element_at("__flat", F.lit(n))
    bare = lambda n: F.when(value(n) != "null", F.coalesce(F.when(value(n).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value(n), F.lit("}")), "v string")["v"]), value(n)))
    return rows.select(*keep, *(bare(n).alias(n) for n in names))
