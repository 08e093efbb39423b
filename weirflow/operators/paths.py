"""Paths with wildcards into nested columns: what lies there, set, removed, lifted.

A path is dotted. A step is a name, with globs (``a*``); a number, into a list; ``*``, every field, value or
element; ``**``, any number of levels. Paths are compiled against the schema to nested ``transform`` and field expressions, so they stay
in Spark's own functions, and rows aren't exploded until asked. Text of JSON, whose
keys aren't known before, is walked as a variant instead (``variant_values``).

A Spark struct has all its fields in every row, so a null and a missing value are the same: neither is among the
values at a path. Values of several types at one path come as text, objects and lists among them as JSON.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fnmatch import fnmatchcase, translate
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY, DEEP = "*", "**"
Found = tuple[Column, T.DataType]


def steps_of(path: str | list[str]) -> list[str]:
    return [s for s in path.split(".") if s] if isinstance(path, str) else list(path)


def wild(step: str) -> bool:
    return any(c in step for c in "*?[")


def whole(df: DataFrame) -> Found:
    """The row as one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema


def as_text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType) else value.cast("string")


def texts(items: Column, kind: T.DataType) -> Column:
    return F.transform(items, lambda x: as_text(x, kind))


def united(parts: list[Found]) -> Found | None:
    """Arrays one after the other; of several types as text."""
    if not parts:
        return None
    kinds = {p[1].simpleString() for p in parts}
    if len(kinds) > 1:
        parts = [(texts(*p), T.StringType()) for p in parts]
    return (F.concat(*(a for a, _ in parts)) if len(parts) > 1 else parts[0][0]), parts[0][1]


def children(value: Column, kind: T.DataType, step: str) -> list[tuple[str, Column, T.DataType]]:
    """The fields of a struct that a step names."""
    return [(f.name, value.getField(f.name), f.dataType) for f in kind.fields if fnmatchcase(f.name, step)] if isinstance(kind, T.StructType) else []


def values(value: Column, kind: T.DataType, steps: list[str]) -> Found | None:
    """An array of what lies at a path of a value, and the type of its elements; None where the schema has no such path."""
    if not steps:
        return F.array_compact(F.array(value)), kind
    step, rest = steps[0], steps[1:]
    parts: list[Found | None] = []
    if step == DEEP:
        parts.append(values(value, kind, rest) if rest else None)
        inner = [DEEP, *rest] if rest else []
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                parts += [values(value.getField(f.name), f.dataType, [])] if not rest else []
                parts.append(values(value.getField(f.name), f.dataType, inner or [DEEP]))
        elif isinstance(kind, T.ArrayType | T.MapType):
            parts.append(values(value, kind, [ANY, *(inner or [DEEP])]))
            parts += [values(value, kind, [ANY])] if not rest else []
    elif isinstance(kind, T.StructType):
        parts = [values(v, k, rest) for _, v, k in children(value, kind, step)]
    elif isinstance(kind, T.ArrayType):
        if step == ANY:
            parts.append(spread(value, kind.elementType, rest))
        elif step.isdigit():
            parts.append(values(F.try_element_at(value, F.lit(int(step) + 1)), kind.elementType, rest))
    elif isinstance(kind, T.MapType):
        if wild(step):
            held = value if step == ANY else F.map_filter(value, lambda k, v: k.rlike(translate(step)))
            parts.append(spread(F.map_values(held), kind.valueType, rest))
        else:
            parts.append(values(F.try_element_at(value, F.lit(step)), kind.valueType, rest))
    return united([p for p in parts if p is not None])


def spread(items: Column, kind: T.DataType, rest: list[str]) -> Found | None:
    """The values at a path of all elements, element by element."""
    if not rest:
        return F.coalesce(F.array_compact(items), F.array().cast(T.ArrayType(kind))), kind
    seen: list[T.DataType] = []

    def inner(x: Column) -> Column:
        found = values(x, kind, rest)
        if found is None:
            return F.array().cast("array<string>")
        seen.append(found[1])
        return found[0]

    out = F.flatten(F.transform(items, inner))
    return (F.coalesce(out, F.array().cast(T.ArrayType(seen[0]))), seen[0]) if seen else None


def values_at(df: DataFrame, path: str | list[str]) -> Column:
    """An array of what lies at a path of the row."""
    found = values(*whole(df), steps_of(path))
    return found[0] if found else F.array().cast("array<string>")


def extract_at(df: DataFrame, path: str | list[str], into: str = "record", keep: list[str] = ()) -> DataFrame:
    """A row for each record at a path: a list there gives its elements, unless the path has a wildcard, whose values are the records."""
    steps = steps_of(path)
    found = values(*whole(df), steps)
    if found is None:
        return df.limit(0).select(*keep, F.lit(None).cast("string").alias(into))
    records, kind = found
    if not any(map(wild, steps)) and isinstance(kind, T.ArrayType):
        records = F.flatten(records)
    return df.select(*keep, F.explode(records).alias(into))


def expand_at(df: DataFrame, path: str | list[str], into: str = "record", emit_parent: bool = False, original: str | None = None) -> DataFrame:
    """A row for each element of the lists at a path, beside the row's columns; other values there give none.

    With ``emit_parent`` a row without elements stays, with a null element; ``original`` names a column that holds the whole row.
    """
    found = values(*whole(df), steps_of(path))
    out = df.withColumn(original, whole(df)[0]) if original else df
    explode = F.explode_outer if emit_parent else F.explode
    items = F.flatten(found[0]) if found and isinstance(found[1], T.ArrayType) else F.array().cast("array<string>")
    return out.select("*", explode(items).alias(into))


def dropped(value: Column, kind: T.DataType, steps: list[str]) -> tuple[Column, T.DataType] | None:
    """A value without what lies at a path; None if nothing of it is left. Elements of lists stay, as their places have a meaning."""
    step, rest = steps[0], steps[1:]
    if step == DEEP and not rest:
        return None
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            inner: tuple[Column, T.DataType] | None = (value.getField(f.name), f.dataType)
            if step == DEEP:
                # here, and at any level below
                inner = None if len(rest) == 1 and fnmatchcase(f.name, rest[0]) else dropped(*inner, rest[1:]) if len(rest) > 1 and fnmatchcase(f.name, rest[0]) else inner
                inner = inner and dropped(*inner, steps)
            elif fnmatchcase(f.name, step):
                inner = dropped(*inner, rest) if rest else None
            if inner is not None:
                parts.append((f.name, *inner))
        if not parts:
            return None
        made = F.struct(*(v.alias(n) for n, v, _ in parts))
        return F.when(value.isNotNull(), made), T.StructType([T.StructField(n, k) for n, _, k in parts])
    if isinstance(kind, T.ArrayType):
        inner_steps = steps if step == DEEP else rest
        if not inner_steps or step != DEEP and step != ANY and not step.isdigit():
            return value, kind
        below = dropped(F.lit(None).cast(kind.elementType), kind.elementType, inner_steps)
        if below is None:
            return value, kind
        if step.isdigit():  # the elements of a list have one type, so a field goes from one of them by becoming null
            at = int(step)
            return F.transform(value, lambda x, i: F.when(i == at, nulled(x, kind.elementType, rest)).otherwise(x)), kind
        return F.transform(value, lambda x: dropped(x, kind.elementType, inner_steps)[0]), T.ArrayType(below[1])
    if isinstance(kind, T.MapType):
        if step != DEEP and not rest:
            return F.map_filter(value, lambda k, v: ~(k.rlike(translate(step)) if wild(step) else k == step)), kind
        if step == DEEP and len(rest) == 1:
            value = F.map_filter(value, lambda k, v: ~(k.rlike(translate(rest[0])) if wild(rest[0]) else k == rest[0]))
        inner_steps = steps if step == DEEP else rest
        below = dropped(F.lit(None).cast(kind.valueType), kind.valueType, inner_steps)
        if below is None:
            return value, kind
        if step not in (DEEP, ANY):
            named = lambda k: k.rlike(translate(step)) if wild(step) else k == step
            return F.transform_values(value, lambda k, v: F.when(named(k), nulled(v, kind.valueType, rest)).otherwise(v)), kind
        return F.transform_values(value, lambda k, v: dropped(v, kind.valueType, inner_steps)[0]), T.MapType(kind.keyType, below[1])
    return value, kind


def nulled(value: Column, kind: T.DataType, steps: list[str]) -> Column:
    return changed(value, kind, steps, lambda old, k: F.lit(None).cast(k))


def remove_at(df: DataFrame, *paths: str | list[str]) -> DataFrame:
    """The rows without what lies at the paths, through lists and maps; missing paths are passed over."""
    for path in paths:
        steps = steps_of(path)
        found = dropped(*whole(df), steps)
        if found is None:
            return df.select()
        df = df.select(found[0].alias("__row")).select("__row.*")
    return df


def changed(value: Column, kind: T.DataType, steps: list[str], change: Callable[[Column, T.DataType], Column]) -> Column:
    """A value in which what lies at a path is changed; the types stay."""
    if not steps:
        return change(value, kind).cast(kind)
    step, rest = steps[0], steps[1:]
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            inner = value.getField(f.name)
            if step == DEEP:
                inner = changed(inner, f.dataType, rest[1:], change) if rest and fnmatchcase(f.name, rest[0]) else inner if rest else changed(inner, f.dataType, [], change)
                inner = changed(inner, f.dataType, steps, change) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else inner
            elif fnmatchcase(f.name, step):
                inner = changed(inner, f.dataType, rest, change)
            parts.append(inner.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        if step == DEEP:
            return F.transform(value, lambda x: changed(x, kind.elementType, steps, change))
        if step == ANY:
            return F.transform(value, lambda x: changed(x, kind.elementType, rest, change))
        if step.isdigit():
            return F.transform(value, lambda x, i: F.when(i == int(step), changed(x, kind.elementType, rest, change)).otherwise(x))
    if isinstance(kind, T.MapType):
        if step == DEEP:
            return F.transform_values(value, lambda k, v: changed(v, kind.valueType, steps, change))
        named = lambda k: k.rlike(translate(step)) if wild(step) else k == step
        return F.transform_values(value, lambda k, v: F.when(named(k), changed(v, kind.valueType, rest, change)).otherwise(v))
    return value


def change_at(df: DataFrame, path: str | list[str], change: Callable[[Column, T.DataType], Column]) -> DataFrame:
    """The rows with ``change(value, type)`` in place of every value at a path."""
    return df.select(changed(*whole(df), steps_of(path), change).alias("__row")).select("__row.*")


def placed(value: Column | None, kind: T.DataType | None, steps: list[str], new: Column) -> Column:
    """A value with ``new`` at a path without wildcards; what is missing on the way is made."""
    if not steps:
        return new
    step, rest = steps[0], steps[1:]
    if isinstance(kind, T.ArrayType) and step.isdigit():
        at, old = int(step), F.coalesce(value, F.array().cast(kind))
        longer = F.transform(F.sequence(F.lit(0), F.greatest(F.size(old) - 1, F.lit(at))), lambda i: F.try_element_at(old, i + 1))
        return F.transform(longer, lambda x, i: F.when(i == at, placed(x, kind.elementType, rest, new)).otherwise(x))
    if isinstance(kind, T.MapType):
        old = F.coalesce(value, F.create_map().cast(kind))
        return F.map_concat(F.map_filter(old, lambda k, v: k != step), F.create_map(F.lit(step), placed(F.try_element_at(old, F.lit(step)), kind.valueType, rest, new).cast(kind.valueType)))
    fields = kind.fields if isinstance(kind, T.StructType) else []
    parts = [(placed(value.getField(f.name), f.dataType, rest, new) if f.name == step else value.getField(f.name)).alias(f.name) for f in fields]
    return F.struct(*parts, *([] if any(f.name == step for f in fields) else [placed(None, None, rest, new).alias(step)]))


def set_at(df: DataFrame, path: str | list[str], new: Column) -> DataFrame:
    """The rows with ``new`` at a path without wildcards: structs on the way are made, a list is filled up with nulls."""
    steps = steps_of(path)
    if any(map(wild, steps)):
        raise ValueError("a new value's path has no wildcards; see change_at")
    return df.select(placed(*whole(df), steps, new).alias("__row")).select("__row.*")


def struct_paths(kind: T.DataType, steps: list[str]) -> list[list[str]]:
    """The paths through structs that a path with wildcards stands for, in the order of the schema."""
    if not steps:
        return [[]]
    if not isinstance(kind, T.StructType):
        return []
    out = struct_paths(kind, steps[1:]) if steps[0] == DEEP and len(steps) > 1 else []
    for f in kind.fields:
        if steps[0] == DEEP or fnmatchcase(f.name, steps[0]):
            out += [[f.name, *p] for p in struct_paths(f.dataType, steps if steps[0] == DEEP and len(steps) > 1 else steps[1:])]
    return out


def lift_at(df: DataFrame, path: str | list[str], drop: bool = False, only: bool = False, prefix: str = "", suffix: str = "") -> DataFrame:
    """The fields of the first struct at a path lifted to the top; if a name is taken nothing changes. ``only`` leaves nothing else."""
    at = lambda p: reduce(lambda k, n: k[n].dataType, p, df.schema)
    found = next((p for p in struct_paths(df.schema, steps_of(path)) if p), None)
    if found is None or not isinstance(at(found), T.StructType):
        return df
    value = reduce(lambda c, n: c.getField(n), found[1:], F.col(f"`{found[0]}`"))
    lifted = {f"{prefix}{n}{suffix}": value.getField(n) for n in at(found).fieldNames()}
    if only:
        return df.select(*(v.alias(n) for n, v in lifted.items()))
    if lifted.keys() & set(df.columns):
        return df
    out = df.select("*", *(v.alias(n) for n, v in lifted.items()))
    return remove_at(out, found) if drop else out


def variant_values(df: DataFrame, column: str, path: str | list[str], into: str = "value", depth: int | None = None) -> DataFrame:
    """A row for each value at a path of a column of JSON text or variants, beside the row's columns; ``into`` is a variant.

    Explicit nulls are values here. ``**`` needs ``depth``, the most levels it stands for.
    """
    steps = steps_of(path)
    if DEEP in steps:
        if depth is None:
            raise ValueError("** in JSON of unknown keys needs a depth")
        at = steps.index(DEEP)
        levels = range(0 if steps[at + 1 :] else 1, depth + 1)
        return reduce(DataFrame.unionByName, [variant_values(df, column, steps[:at] + [ANY] * n + steps[at + 1 :], into, depth) for n in levels])
    tvf = df.sparkSession.tvf
    kind = df.schema[column].dataType
    out = df.select("*", (F.col(column) if isinstance(kind, T.VariantType) else F.try_parse_json(column)).alias("__v"))
    for step in steps:
        if wild(step):
            each = tvf.variant_explode(F.col("__v").outer()).select(F.col("key").alias("__key"), F.col("value").alias("__next"))
            out = out.lateralJoin(each)
            out = out if step == ANY else out.where(F.col("__key").rlike(translate(step)))
        else:
            name = re.sub(r"(['\\])", r"\\\1", step)
            field = F.try_variant_get("__v", f"$['{name}']", "variant")
            found = F.coalesce(field, F.try_variant_get("__v", f"$[{int(step)}]", "variant")) if step.isdigit() else field
            out = out.withColumn("__next", found).where("__next is not null")
        out = out.drop("__v", "__key").withColumnRenamed("__next", "__v")
    return out.where("__v is not null").withColumnRenamed("__v", into)
